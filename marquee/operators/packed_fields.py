"""Problem 3: fields that pack several values behind inconsistent delimiters.

Segmentation is dictionary-guided. The dictionary holds every distinct whole value of the field with its number of
occurrences, learned from all rows: quoted values, and unquoted runs between delimiters. A multi-pattern automaton finds known
values in a field, whatever delimiters they hold; the quoting rules and the unknown runs give further arcs; dynamic
programming picks the likeliest cover of the field by arcs, a value costing less the more often it is known to occur;
characters outside an arc are separators. So a value quoted in some rows keeps its delimiters where it stands unquoted in
others, unless its parts by themselves are likelier.

The dictionary may grow with the data and is never held whole: a field is joined with the entries whose words, from the first
to the last, stand in it, and only those go to the automaton.

guard=False is for data whose rule is that a delimiter outside quotes always separates: the quoting rules alone decide, and
split_packed reads the fields by them without a dictionary.

Defined cases: a null, empty or blank field gives no row; the parenthesised placeholder gives no value; a quote that is
never closed counts as a separator; values that are empty after stripping are dropped and take no position; a null record
id is kept; identical output rows are reported once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import ship, written

#: Characters besides letters, marks and digits that an unquoted value may hold.
INNER = " -‐‑'’&"
#: Closing characters by opening quote.
QUOTES = {'"': '"', "“": "”", "”": "”", "„": "“”", "‟": "”"}
PLACEHOLDER = "(no genres listed)"
#: Parts a hot join key's rows are dealt over.
SALT = 16

_WORD = re.compile(r"[^\W_]+(?:[-‐‑'’&]+[^\W_]+)*")
_COST_SEPARATOR = 0.01


def _in_value(c: str) -> bool:
    return c.isalnum() or c in INNER or unicodedata.category(c)[0] == "M"


def quoted_span(text: str, i: int) -> tuple[int, str] | None:
    """End and content of the quoted value opening at i; None if it is never closed."""
    closers = QUOTES[text[i]]
    j, out = i + 1, []
    while j < len(text):
        if text[j] in closers:
            if text[i] == '"' and text[j + 1 : j + 2] == '"':
                out.append('"')
                j += 2
                continue
            return j + 1, "".join(out)
        out.append(text[j])
        j += 1
    return None


class Segmenter:
    """Cuts one field into its values by the likeliest cover of arcs.

    known: whole values with their numbers of occurrences (once each for a plain list). total: occurrences of all values.
    guard: a known value that holds delimiters may stand unquoted; without it such a value is cut at them in the end.
    """

    def __init__(self, known: Mapping[str, int] | Iterable[str], guard: bool = False, placeholder: str = PLACEHOLDER, total: int | None = None):
        import ahocorasick

        self.placeholder, self.guard = placeholder.lower(), guard
        counts = {v.strip(): n for v, n in (known.items() if isinstance(known, Mapping) else ((v, 1) for v in known))}
        total = max(total or 0, sum(counts.values()), 1)
        self.unknown = math.log(2 * total) + _COST_SEPARATOR
        self.automaton = ahocorasick.Automaton()
        for value, n in counts.items():
            if value and value.lower() != self.placeholder:
                self.automaton.add_word(value, (len(value), math.log(total / n) + _COST_SEPARATOR))
        if len(self.automaton):
            self.automaton.make_automaton()

    def arcs(self, text: str) -> list[list[tuple[int, float, str | None, bool]]]:
        """By start: (end, cost, value or None for no value, whether it is a known one that stands unquoted)."""
        n = len(text)
        out: list[list[tuple[int, float, str | None, bool]]] = [[] for _ in range(n)]
        inside = [_in_value(c) for c in text]
        spans: list[tuple[int, int]] = []
        i = 0
        while i < n:
            if text[i] in QUOTES and (span := quoted_span(text, i)):
                out[i].append((span[0], 0.0, span[1], False))
                spans.append((i, span[0]))
                i = span[0]
            elif text[i] == "(" and text[i : i + len(self.placeholder)].lower() == self.placeholder:
                out[i].append((i + len(self.placeholder), 0.0, None, False))
                spans.append((i, i + len(self.placeholder)))
                i += len(self.placeholder)
            elif inside[i]:
                j = i
                while j < n and inside[j]:
                    j += 1
                out[i].append((j, _COST_SEPARATOR if text[i:j].isspace() else self.unknown, text[i:j], False))
                i = j
            else:
                out[i].append((i + 1, _COST_SEPARATOR, None, False))
                i += 1
        if len(self.automaton):
            for last, (length, cost) in self.automaton.iter(text):
                a, b = last + 1 - length, last + 1
                while a and text[a - 1] == " ":
                    a -= 1
                while b < n and text[b] == " ":
                    b += 1
                whole = (a == 0 or not inside[a - 1] or not inside[a]) and (b == n or not inside[b] or not inside[b - 1])
                if whole and all(e <= a or b <= s or (a <= s and e <= b and (a, b) != (s, e)) for s, e in spans):  # a quoted part may lie inside
                    out[a].append((b, cost, text[a:b], True))
        return out

    def values(self, text: str | None) -> list[str]:
        """The values of a field in order, stripped, without empty ones."""
        if not text:
            return []
        n, arcs = len(text), self.arcs(text)
        best: list[tuple[float, int, str | None, bool]] = [(0.0, 0, None, False)] + [(float("inf"), 0, None, False)] * n
        for i in range(n):
            at = best[i][0]
            if at == float("inf"):
                continue
            for end, cost, value, known in arcs[i]:
                if at + cost < best[end][0]:
                    best[end] = (at + cost, i, value, known)
        out, i = [], n
        while i:
            _, start, value, known = best[i]
            if value is not None:
                parts = Segmenter([]).values(value) if known and not self.guard else [value]
                out += [v for x in parts[::-1] if (v := x.strip()) and v.lower() != self.placeholder]
            i = start
        return out[::-1]


def core(text: str) -> tuple[str, int]:
    """The text from its first word to its last, and the number of words; empty without words."""
    words = list(_WORD.finditer(text))
    return (text[words[0].start() : words[-1].end()], len(words)) if words else ("", 0)


def learn_dictionary(df: DataFrame, field: str) -> DataFrame:
    """(value, n): every distinct whole value of the field and its number of occurrences, counted on all rows."""
    ship(df.sparkSession)
    fields = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("f")).agg(F.count("*").alias("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Segmenter([])
        for batch in batches:
            found = [(v, n) for f, n in zip(*(c.to_pylist() for c in batch.columns)) for v in grammar.values(f)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["value", "n"])

    return fields.mapInArrow(read, "value string, n bigint").groupBy("value").agg(F.sum("n").alias("n"))


def _salted(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left joined with right on a key that may be hot on the left; right's rows are few and small a key."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALT)).cast("int")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("__salt", salt).join(copies, [key, "__salt"], how).drop("__salt")


def relevant(fields: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(f, known): distinct fields f and the entries, (value, n) structs, of a dictionary whose words stand in them."""

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [core(v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32())], ["value", "n", "core", "words"])

    entries = written(dictionary.select("value", F.col("n").cast("bigint").alias("n")).mapInArrow(cores, "value string, n bigint, core string, words int"), "dictionary")
    lengths = sorted(r.words for r in entries.select("words").distinct().collect() if r.words)  # numbers of words: few

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0).to_pylist():
                words = [m.span() for m in _WORD.finditer(f)]
                found = {f[words[i][0] : words[i + k - 1][1]] for k in lengths for i in range(len(words) - k + 1)}
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(found), pa.string()), pa.array(sorted(found), pa.string())], ["f", "core"])

    near = _salted(fields.mapInArrow(stretches, "f string, core string"), entries.where("words > 0").drop("words"), "core", "inner")
    known = near.groupBy("f").agg(F.collect_list(F.struct("value", "n")).alias("known"))  # no more than the stretches of a field
    return fields.join(known, "f", "left")


def split_packed(df: DataFrame, record: str, field: str, *, out_record: str = "record_id", out_value: str = "value", guard: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """One row (record, pos, value) per value of a packed field; pos counts a record's values from 1.

    guard=True: the likeliest cover by known values decides; dictionary: (value, n) of known whole values, those of the field
    itself by default. Without guard a delimiter outside quotes always separates, which no dictionary can change, so none is
    learned or looked up.
    """
    ship(df.sparkSession)
    source = df.select(F.col(record).alias("r"), F.col(field).cast("string").alias("f")).where("f is not null").distinct()
    if not guard:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grammar = Segmenter([])
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grammar.values(f) for f in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["r", "v"])

        return _listed(source.mapInArrow(read, f"r {source.schema['r'].dataType.simpleString()}, v array<string>"), out_record, out_value)
    known = learn_dictionary(df, field) if dictionary is None else dictionary
    known = written(known.where("value is not null").groupBy("value").agg(F.sum("n").alias("n")), "known")
    total = known.agg(F.sum("n")).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                entries = {e["value"]: e["n"] for found in part.column(1).to_pylist() for e in found or ()}
                segmenter = Segmenter(entries, guard, total=total)
                values = [segmenter.values(f) for f in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.list_(pa.string()))], ["f", "v"])

    cuts = relevant(source.select("f").distinct(), known).mapInArrow(cut, "f string, v array<string>")
    return _listed(_salted(source, cuts, "f", "inner"), out_record, out_value)


def _listed(cuts: DataFrame, out_record: str, out_value: str) -> DataFrame:
    """(r, ..., v) to distinct rows (record, pos, value), positions from 1."""
    rows = cuts.select(F.col("r").alias(out_record), F.posexplode("v").alias("pos", out_value))
    return rows.withColumn("pos", (F.col("pos") + 1).cast("bigint")).distinct()
