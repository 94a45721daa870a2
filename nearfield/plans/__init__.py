"""The store's state, its settings and the maintenance cycle."""
