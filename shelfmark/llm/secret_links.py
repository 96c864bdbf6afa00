"""Secrets by multipart credential linking.

Some secrets show by themselves: assignments to a password-like name, access
identifiers, long hexadecimal runs. Others are weak: a login name, a random
looking key or an address is no secret alone. They are reported where the parts
that complete a credential stand close together: all parts of a text are placed
on one line of numbers, and three interval joins (identifiers, secrets,
endpoints) tell which part has which other part within reach and scope.

Parts and roles. Strong: ``assign`` and ``hex`` (secret), ``access``
(identifier). Weak: ``login`` (identifier, reported beside a secret), ``key``
(secret, beside an identifier), ``endpoint`` (beside an identifier and a
secret). Weak parts help each other, so a login and a key next to each other
are both reported. A scope is a block of text without a blank line; within
reach are parts with at most 300 code points between them. A weak part that
overlaps a strong one is dropped, and so is a key that overlaps a login or an
endpoint.

All parts of a scope lie in one text, so texts stay where they are: no shuffle,
whatever a text or a group of copies holds. The joins run over all texts of an
Arrow batch at once, by sorting and binary search, so a text full of candidates
costs n log n, never a pair for each two of them. Positions need Python: Spark
has no function for the places of all matches. Texts that RE2 finds free of a
kind are not searched for it.

Edge cases. NULL counts as empty, without parts. Rows repeat and ids may be
NULL: every row stands for itself. Letters of names are matched in either case
for A-Z only. Positions count code points; ends are exclusive. An empty table
gives an empty result. Other columns, whatever their names, are kept by
``scan`` and ``masked``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from shelfmark.llm.common import fresh
from shelfmark.llm.tokens import slices

REACH = 300

# The strong patterns. The weak ones are this module's own.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

LOGIN = r"""(username|user|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)"""
KEY = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(https?://[^\x20\x09-\x0D"'<>]+|(host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]+)"""
LOGIN_LEAST = 3
SCOPE_END = r"\n[\x20\x09\x0D]*\n"

STRONG, WEAK = ("assign", "access", "hex"), ("login", "key", "endpoint")
KINDS = STRONG + WEAK
_CASELESS = re.IGNORECASE | re.ASCII
_PATTERNS = {
    "assign": re.compile(ASSIGN, _CASELESS), "access": re.compile(ACCESS), "hex": re.compile(HEX),
    "login": re.compile(LOGIN, _CASELESS), "key": re.compile(KEY), "endpoint": re.compile(ENDPOINT, _CASELESS),
}
_BREAK = re.compile(SCOPE_END)
_MIXED = tuple(re.compile(c) for c in ("[0-9]", "[A-Z]", "[a-z]"))

SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _counts(kind: str, match: re.Match) -> bool:
    """Whether a match of the pattern is a part."""
    if kind == "assign":
        return len(match[2]) >= ASSIGN_LEAST
    if kind == "access":
        return len(match[0]) >= ACCESS_LEAST
    if kind == "login":
        return len(match[2]) >= LOGIN_LEAST
    return kind != "key" or all(c.search(match[0]) for c in _MIXED)


def _parts(texts: pa.Array) -> np.ndarray:
    """Rows ``text, kind, start, end, scope`` of all parts, in this order; weak ones only beside identifiers."""
    possible = {
        kind: pc.match_substring_regex(texts, pattern.pattern, ignore_case=kind not in ("access", "hex", "key")).to_numpy(zero_copy_only=False)
        for kind, pattern in _PATTERNS.items() if kind not in ("key", "endpoint")
    }
    # Without an identifier no weak part is ever reported.
    possible["key"] = possible["endpoint"] = possible["access"] | possible["login"]
    rows = []
    for i in np.flatnonzero(np.logical_or.reduce(list(possible.values()))):
        text, found = texts[i].as_py(), []
        for k, kind in enumerate(KINDS):
            if possible[kind][i]:
                found += [(i, k, *m.span()) for m in _PATTERNS[kind].finditer(text) if _counts(kind, m)]
        if possible["key"][i]:
            ends = np.array([m.start() for m in _BREAK.finditer(text)], np.int64)
            scopes = np.searchsorted(ends, [f[2] for f in found], side="left")
        else:
            scopes = [0] * len(found)
        rows += [(*f, s) for f, s in zip(found, scopes, strict=True)]
    return np.array(rows, np.int64).reshape(-1, 5)


def _beside(low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Interval join: for each of ``low..high`` whether an interval of the other side meets it, ends included."""
    if not len(start):
        return np.zeros(len(low), bool)
    order = np.argsort(start, kind="stable")
    start, reached = start[order], np.maximum.accumulate(end[order])
    before = np.searchsorted(start, high, side="right")
    return (before > 0) & (reached[np.maximum(before, 1) - 1] >= low)


def linked(parts: np.ndarray, lengths: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The parts that are reported: strong ones, and weak ones whose credential is complete."""
    if not len(parts):
        return parts
    # Texts and scopes lie further apart than the reach, so distance alone decides.
    text, kind, start, end, scope = parts.T
    gap = reach + 1
    scopes = np.zeros(len(lengths), np.int64)
    np.maximum.at(scopes, text, scope)
    origin = np.concatenate([[0], np.cumsum(lengths + (scopes + 1) * gap)])[:-1]
    shift = origin[text] + scope * gap
    start, end = start + shift, end + shift
    is_kind = {name: kind == k for k, name in enumerate(KINDS)}

    def near(role: np.ndarray, within: int) -> np.ndarray:
        # Half-open intervals: with -1 they have to overlap.
        return _beside(start - within, end + within, start[role], end[role])

    strong = np.isin(kind, range(len(STRONG)))
    alone = ~near(strong, -1)
    login, endpoint = is_kind["login"] & alone, is_kind["endpoint"] & alone
    key = is_kind["key"] & alone & ~near(login | endpoint, -1)
    identifier = near(is_kind["access"] | login, reach)
    secret = near(is_kind["assign"] | is_kind["hex"] | key, reach)
    return parts[strong | (login & secret) | (key & identifier) | (endpoint & identifier & secret)]


def _spans(texts: pa.Array, reach: int) -> pa.Array:
    texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = linked(_parts(texts), lengths, reach)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 2], rows[:, 0]))]
    offsets = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    kinds = pa.array(KINDS).take(pa.array(rows[:, 1]))
    values = pa.StructArray.from_arrays([kinds, pa.array(rows[:, 2]), pa.array(rows[:, 3])], ["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(_ARROW_SPANS)


def scan(docs: DataFrame, text: str = "text", reach: int = REACH, name: str = "secrets") -> DataFrame:
    """Documents with an array of the secrets found, ``kind, start, end``, by start and kind.

    The column gets another name where ``name`` is taken; it is the last one.
    """
    name, at = fresh(docs, name), docs.columns.index(text)
    # Plain names on the way to Python and back, as a column may have a dot in its name.
    plain = [f"c{i}" for i in range(len(docs.columns))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                spans = _spans(part.column(at).cast(pa.string()), reach)
                yield pa.RecordBatch.from_arrays([*part.columns, spans], [*plain, "spans"])

    fields = [StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)]
    return docs.toDF(*plain).mapInArrow(find, StructType([*fields, StructField("spans", SPANS)])).toDF(*docs.columns, name)


def masked(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """Documents whose secrets are replaced by their kind in brackets; overlapping ones by the first kind."""
    found = scan(docs, text, reach)
    name = found.columns[-1]
    # (text so far, place in the original): each span adds what stands before it and its mark.
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state, span):
        before = F.substring(F.col(text), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        mark = F.when(span["start"] < state["at"], "").otherwise(F.concat(before, F.lit("["), span["kind"], F.lit("]")))
        return F.struct(F.concat(state["done"], mark).alias("done"), F.greatest(state["at"], span["end"]).alias("at"))

    clean = F.aggregate(name, start, step, lambda s: F.concat(
        s["done"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.char_length(F.col(text)))))
    replaced = F.when(F.size(name) == 0, F.col(text)).otherwise(clean)
    return found.select(*[replaced.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """Numbers and places of the secrets of every document, and a digest of the strong ones."""
    found = scan(docs.select("doc_id", "text")).select("doc_id", "secrets")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(*kinds):
        return F.size(F.filter("secrets", lambda s: s["kind"].isin(*kinds))).cast("long")

    strong = F.filter("secrets", lambda s: s["kind"].isin(*STRONG))
    return found.select(
        "doc_id", *[number(kind).alias(f"n_{kind}") for kind in STRONG], F.sha2(joined(strong), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"), number(*WEAK).alias("n_linked"))
