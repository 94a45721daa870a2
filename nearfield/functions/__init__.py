"""Column builders: vector arithmetic, similarity and expiry. All of them stay inside the JVM."""

from nearfield.functions.ttl import expired
from nearfield.functions.vectors import add, contains, cosine, divide, dot, equal, l1_distance, l2_distance, norm, scale, subtract, vec, vec_mean

__all__ = ["add", "contains", "cosine", "divide", "dot", "equal", "expired", "l1_distance", "l2_distance", "norm", "scale", "subtract", "vec", "vec_mean"]
