"""Chat formatting (operator 1) by incremental black-box rendering.

A template is any function from a list of turns to a string. Each conversation's turns are rendered one prefix after the
other; consecutive outputs must agree up to the part that closes an unfinished conversation, and what the longer one adds
is the turn's span. Where they don't agree, the template rewrites history, and the first such turn is reported. Where a
turn's text lies within its span is found the same way: two renderings that differ in the last turn's text alone share
what precedes and what follows it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_LABELS = {"user": "User", "assistant": "Assistant", "system": "System"}
_ROLES = {v: k for k, v in _LABELS.items()}
_BACK = {"\\b": "\\", "\\h": "###", "\\e": "</turn>", "\\c": ": "}
_TURN = re.compile(r"### (=?)((?:(?!: ).)*): (.*?)</turn>\n", re.S)


def escape(text: str) -> str:
    """Without control strings: no ### and no </turn> is left, and a backslash always begins an escape."""
    return text.replace("\\", "\\b").replace("###", "\\h").replace("</turn>", "\\e")


def unescape(text: str) -> str:
    return re.sub(r"\\[bhec]", lambda m: _BACK[m[0]], text)


def label(role: str) -> str:
    return _LABELS.get(role) or "=" + escape(role).replace(": ", "\\c")


def marked(turns: list[Turn]) -> str:
    """The template of the query: "### Role: text</turn>" lines, with control strings in texts escaped."""
    return "".join(f"### {label(role)}: {escape(text)}</turn>\n" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns that ``marked`` rendered."""
    out, pos = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != pos:
            break
        out.append((unescape(m[2]) if m[1] else _ROLES[m[2]], unescape(m[3])))
        pos = m.end()
    if pos != len(formatted):
        raise ValueError(f"not a formatted conversation at character {pos}")
    return out


def _common(a: str, b: str) -> int:
    """How many characters ``a`` and ``b`` begin with alike; comparisons of slices halve the range that is left."""
    if b.startswith(a) or a.startswith(b):
        return min(len(a), len(b))
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _common_end(a: str, b: str) -> int:
    if a.endswith(b) or b.endswith(a):
        return min(len(a), len(b))
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]:
            low = mid
        else:
            high = mid - 1
    return low


def spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]], int | None]:
    """The rendering of all turns, each turn's span in it, and the first turn whose rendering changed what was before it
    (None if none did; spans from there on are empty).

    A template may close its output: the longest part that a next turn replaced and that all outputs end with is no
    turn's. A turn that replaces more than that has changed what was before it.
    """
    return _spans(turns, template)[:3]


def _spans(turns: list[Turn], template: Template, learn: str | None = None) -> tuple[str, list[tuple[int, int]], int | None, list[tuple[int, int]]]:
    """``spans``, and where the texts of role ``learn`` lie as long as nothing is rewritten. Prefixes are rendered one after
    the other, and two renderings are held at a time: that all outputs end with a part is known from what is common to
    all their ends."""
    before, end, sizes, replaced, texts = "", "", [], [], []
    for k in range(len(turns)):
        out = template(turns[: k + 1])
        if k:
            replaced.append(len(before) - _common(before, out))
        common = _common_end(end, out) if k else len(out)
        end = out[len(out) - common :]
        sizes.append(len(out))
        texts.append(_inside(turns[: k + 1], template, out) if turns[k][0] == learn else None)
        before = out
    closing = max((r for r in replaced if r <= len(end)), default=0)
    rewritten = next((k + 1 for k, r in enumerate(replaced) if r > closing), None)
    ends = [n - closing for n in sizes]
    whole = len(turns) if rewritten is None else rewritten
    where = [(a, b) if k < whole else (0, 0) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    return before, where, rewritten, [t if w[0] <= t[0] else w for t, w in zip(texts, where, strict=True) if t]


def _inside(turns: list[Turn], template: Template, whole: str) -> tuple[int, int]:
    """Where the text of the last of ``turns`` lies in ``whole``, the rendering of all of them."""
    a, b = (template([*turns[:-1], (turns[-1][0], probe)]) for probe in ("A", "B"))
    head = _common(a, b)
    return head, max(head, len(whole) - (len(a) - head - 1))


def text_span(turns: list[Turn], template: Template, span: tuple[int, int]) -> tuple[int, int]:
    """Where the text of the last of ``turns`` lies, whose turn has the given span in the rendering of all of them."""
    found = _inside(turns, template, template(turns))
    return found if span[0] <= found[0] else span


def places(turns: list[Turn], k: int, template: Template) -> list[tuple[int, int]]:
    """Where the text of turn ``k`` lies in the rendering of all ``turns``: every place, none if it isn't there as it was
    probed (two renderings that differ in that text alone)."""
    a, b = (template([*turns[:k], (turns[k][0], probe), *turns[k + 1 :]]) for probe in ("A", "B"))
    whole = template(turns)
    at = [i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y]
    if not at or len(a) != len(b):
        return []
    size, rest = divmod(len(whole) - len(a) + len(at), len(at))
    pieces = [a[i:j] for i, j in zip([0, *[i + 1 for i in at]], [*at, len(a)], strict=True)]
    out = [(i + n * (size - 1), i + n * (size - 1) + size) for n, i in enumerate(at)]
    if rest or size < 0 or "".join(p + whole[s:e] for p, (s, e) in zip(pieces, out, strict=False)) + pieces[-1] != whole:
        return []
    return out


def format_chats(conversations: DataFrame, template: Template = marked, learn: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, spans, texts, rewrites_at): one row for each conversation.

    ``spans`` are the turns' places in ``formatted`` (start, end, role); ``texts`` the places of the texts of role
    ``learn``, the loss mask; ``rewrites_at`` is the first turn that rewrote history, else null. After a rewrite, both are the
    places of the turns' texts in the final rendering: a span is the first such place, empty if there is none. Turns are taken by turn,
    ties by role and text, so repeated rows are turns of their own; null texts and roles count as empty; null turns come
    first; rows without a conv_id are one conversation; an empty table gives no rows. Rendering prefixes takes a
    conversation's turns times its length.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def one(conv: int | None, turns: list[Turn]) -> dict:
        out, where, rewritten, texts = _spans(turns, template, learn)
        if rewritten is not None:
            found = [places(turns, k, template) for k in range(len(turns))]
            where = [f[0] if f else (0, 0) for f in found]
            texts = sorted(p for f, (role, _) in zip(found, turns, strict=True) if role == learn for p in f)
        return {
            "conv_id": conv, "n_turns": len(turns), "formatted": out, "spans": [{"start": a, "end": b, "role": r} for (a, b), (r, _) in zip(where, turns, strict=True)],
            "texts": [{"start": a, "end": b} for a, b in texts], "rewrites_at": rewritten,
        }

    place = [("start", pa.int64()), ("end", pa.int64())]
    arrow = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([*place, ("role", pa.string())]))), ("texts", pa.list_(pa.struct(place))), ("rewrites_at", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, turns, done, size = False, None, [], [], 0
        for batch in batches:
            for c, r, t in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if begun and c != conv:
                    done.append(one(conv, turns))
                    size += len(done[-1]["formatted"])
                    turns = []
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(done, arrow)
                        done, size = [], 0
                begun, conv = True, c
                turns.append((r, t))
        if begun:
            done.append(one(conv, turns))
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, formatted string, spans array<struct<start: long, end: long, role: string>>, texts array<struct<start: long, end: long>>, rewrites_at long")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations finds: their turns, and the text under the loss mask."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, out, mask in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                turns = parse(out)
                read, loss = hashlib.sha256(), "".join(unescape(out[m["start"] : m["end"]]) for m in mask)
                for role, text in turns:
                    read.update(f"{role}\n{text}\n".encode())
                rows.append((conv, len(turns), read.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return formatted.select("conv_id", "formatted", "texts").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one that quotes the template's control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(rows.union(extra)))


OP1_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}'))),
e AS (SELECT *, length('### : </turn>') + 1 + length(replace(replace(replace(text, chr(92), chr(92) || 'b'), '###', chr(92) || 'h'), '</turn>', chr(92) || 'e'))
  + CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role)
    ELSE 1 + length(replace(replace(replace(replace(role, chr(92), chr(92) || 'b'), '###', chr(92) || 'h'), '</turn>', chr(92) || 'e'), ': ', chr(92) || 'c')) END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
