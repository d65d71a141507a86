"""Personal data by bootstrapped contextual extraction.

Entities of four fixed formats are the seeds.  The words around a seed make lexical patterns; every identifier-like
token in the corpus is an instance of the patterns around it.  Spark scores the pattern-instance graph: a pattern of
which nearly all instances are known entities of one kind is accepted, instances of accepted patterns become
known, and both are scored again until nothing new is found.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Keyed, fresh, stage, texts_of, with_length

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_word_before = re.compile(r"[A-Za-z0-9._%+-]")
# a match that starts within a run of digits would end like one that starts with the run
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]").search
_word = re.compile(r"[^\x20\x09-\x0D]+")
_trim = "\"'`()[]{}<>,;:.!?"
_four_digits = re.compile(r"(?:[^0-9]*[0-9]){4}").match
#: Several tokens of digits and separators with single blanks between them.
_run = re.compile(r"(?<![^\x20\x09-\x0D\"'`\[{<])[(+]*[0-9][0-9()./-]*(?:\x20\(?[0-9][0-9()./-]*)+(?![^\x20\x09-\x0D\"'`\]}>,;:.!?])")
#: Names in front of a value.
_name = re.compile(r"(?:[^0-9:=@\x20\x09-\x0D]++[:=])+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: each @ is tried with the run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _word_before.match(text, start - 1):
            start -= 1
        if start < at and (domain := _domain.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start; code points, end exclusive."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _digit(text):
        spans += [("ip", *m.span()) for m in _ip.finditer(text) if all(
            len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _card.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            spans += [("phone", *m.span()) for m in _phone.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return spans


@dataclass(frozen=True)
class Bootstrap:
    """A pattern is accepted from ``support`` distinct known instances of one kind on if they are at least ``share`` of
    all its distinct instances; an instance if the accepted patterns around it are wrong together with a chance of at
    most ``doubt``."""

    support: int = 5
    share: float = 0.9
    doubt: float = 0.1


#: Code points of a word that count in a pattern: those next to the span.
REACH = 80


class Words:
    """Where the words of a text are."""

    def __init__(self, text: str):
        ends = np.fromiter((x for m in _word.finditer(text) for x in m.span()), np.int64)
        self.text, self.starts, self.ends = text, ends[::2], ends[1::2]

    def patterns(self, start: int, end: int) -> list[str]:
        """Contexts of a span: what is glued to its front, the two words before it, and one word on either side."""
        text, starts, ends = self.text, self.starts, self.ends
        first = int(np.searchsorted(starts, start, side="right")) - 1
        last = int(np.searchsorted(starts, end - 1, side="right")) - 1
        glued = text[max(int(starts[first]), start - REACH):start].lower()
        before = [w for k in range(max(0, first - 2), first)
                  for w in [text[max(int(starts[k]), int(ends[k]) - REACH):int(ends[k])].strip(_trim).lower()]]
        following = [text[int(starts[k]):min(int(ends[k]), int(starts[k]) + REACH)].strip(_trim).lower()
                     for k in range(last + 1, min(last + 2, len(starts)))]
        found = []
        if any(c.isalpha() for c in glued):
            found.append("glued " + glued)
        if len(before) == 2:
            found.append("before " + " ".join(before))
        if before and following:
            found.append(f"around {before[-1]} _ {following[0]}")
        return found


def _bare(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its ends; a bracket at the front stays if it closes inside."""
    while start < end and text[start] in _trim and not (text[start] == "(" and ")" in text[start:end].rstrip(_trim + "-/")):
        start += 1
    while start < end and text[end - 1] in _trim + "-/":
        end -= 1
    return start, end


def candidates(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """What looks like an identifier outside the spans, in order.

    Runs of several tokens of digits, brackets and -./ with single blanks between them are one candidate; so is any
    other token with four digits or more, or with an @ inside.  A leading ``name=`` or ``name:`` without digits is left out; colons
    further on are part of the token.  A run that meets a span is taken token by token.
    """
    if not ("@" in text or _four_digits(text)):
        return
    taken = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    runs = [span for m in _run.finditer(text) for span in [_bare(text, *m.span())]
            if _four_digits(text[slice(*span)]) and " " in text[slice(*span)] and free(*span)]
    k = 0
    for m in _word.finditer(text):
        start, end = m.span()
        while k < len(runs) and runs[k][1] <= start:
            yield runs[k]
            k += 1
        if k < len(runs) and runs[k][0] < end:
            continue
        if not (_four_digits(m.group()) or "@" in m.group()):
            continue
        if name := _name.match(text, start, end):
            start = name.end()
        start, end = _bare(text, start, end)
        token = text[start:end]
        if (_four_digits(token) or "@" in token[1:-1]) and free(start, end):
            yield start, end
    yield from runs[k:]


SPAN = "struct<kind:string,start:long,end:long>"
FOUND = f"doc long, spans array<{SPAN}>, seen array<struct<kind:string,start:long,end:long,value:string,patterns:array<string>>>"


def extract(docs: DataFrame) -> DataFrame:
    """Per document its base spans and, for these and all candidates, the value and the patterns around it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, seen = [], []
            for text in texts_of(batch):
                base = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                places = base + [(None, a, b) for a, b in candidates(text, base)]
                words = Words(text) if places else None
                seen.append([{"kind": k, "start": a, "end": b, "value": text[a:b], "patterns": words.patterns(a, b)}
                             for k, a, b in places])
            span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            place = pa.struct([*span, ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(span)), pa.array(seen, pa.list_(place))],
                names=["doc", "spans", "seen"])

    return docs.select("doc", "text").mapInArrow(run, FOUND)


def bootstrap(seen: DataFrame, rules: Bootstrap = Bootstrap()) -> DataFrame:
    """(value, kind) of the values that patterns reveal; ``seen`` has (value, kind or null, pattern) per occurrence."""
    graph = stage(seen.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "pattern-graph")
    known = graph.filter("seed is not null").select("value", F.col("seed").alias("kind")).groupBy("value").agg(
        F.max("kind").alias("kind"))
    found, met = None, set()
    while True:
        labelled = graph.select("pattern", "value").join(known, "value", "left")
        counts = labelled.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        totals = labelled.groupBy("pattern").agg(F.count("*").alias("total"))
        accepted = counts.filter(F.col("kind").isNotNull() & (F.col("n") >= rules.support)).join(
            totals, "pattern").filter(F.col("n") >= rules.share * F.col("total")).select(
            "pattern", F.col("kind").alias("kind"), (1 - F.col("n") / (F.col("total") + 1)).alias("wrong"))
        accepted = stage(accepted, "accepted-patterns")
        if accepted.isEmpty():
            break
        doubt = graph.filter("seed is null").join(accepted, "pattern").groupBy("value", "kind").agg(
            F.sum(F.log("wrong")).alias("doubt")).filter(F.col("doubt") <= F.log(F.lit(rules.doubt)))
        # the kind with the least doubt, the first by name on ties
        best = doubt.groupBy("value").agg(F.min(F.struct("doubt", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"))
        found = stage(best, "revealed")
        # the same members as in an earlier round: a fixed point, or a circle
        now = tuple(found.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), "value", "kind").cast("decimal(38,0)")) for k in (1, 2)]).first())
        if not now[0] or now in met:
            break
        met.add(now)
        seeds = graph.filter("seed is not null").groupBy("value").agg(F.max("seed").alias("kind"))
        known = seeds.union(found.join(seeds, "value", "left_anti"))
    return found if found is not None else known.limit(0)


def personal_data(docs: DataFrame, rules: Bootstrap = Bootstrap()) -> DataFrame:
    """(doc_id, base array<span>, spans array<span>) of every id; spans are the base ones and those that patterns reveal.

    Spans have a kind, start and end in code points (end exclusive) and are listed by kind (KINDS) and start.  A null or
    empty text has none.  Rows that share an id stay apart; ids may be null; further columns are not read; an empty
    table gives no row.
    """
    rows = Keyed(docs)
    return rows.with_ids(_found(rows, rules), doc="doc_id")


def _found(rows: Keyed, rules: Bootstrap) -> DataFrame:
    """(doc, base, spans) of every row key."""
    places = stage(extract(rows.texts), "pii")
    seen = places.select("doc", F.explode("seen").alias("s"))
    values = bootstrap(seen.select(F.col("s.value").alias("value"), F.col("s.kind").alias("kind"),
                                   F.explode("s.patterns").alias("pattern")), rules)
    more = (seen.filter("s.kind is null").select("doc", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                                                 F.col("s.value").alias("value"))
            .join(values, "value").groupBy("doc").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    every = F.concat("spans", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))
    ordered = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(
        F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return places.select("doc", "spans").join(more, "doc", "left").select(
        "doc", F.col("spans").alias("base"), ordered.alias("spans"))


def masked(docs: DataFrame, rules: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with each span's text replaced by its kind in angle brackets, and ``n_chars`` brought up to date.

    Base spans are found again in the row itself, so only documents with revealed spans are joined.  Overlapping spans
    are replaced together, under the kind of the first.  Columns, rows and null texts stay.
    """
    rows, more = Keyed(docs), fresh(docs.columns, "revealed")
    revealed = _found(rows, rules).filter("size(spans) > size(base)").select(
        F.col("doc").alias(rows.key), F.array_except("spans", "base").alias(more))
    joined = rows.table.join(revealed, rows.key, "left")

    @F.pandas_udf("string")
    def mask(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, more):
            if t is None:
                return None
            places = [(a, -b, k) for k, a, b in base_spans(t)]
            places += [(x["start"], -x["end"], x["kind"]) for x in (more if more is not None else ())]
            out, at = [], 0
            for a, b, k in sorted(places):
                if a >= at:
                    out += [t[at:a], f"<{k.upper()}>"]
                at = max(at, -b)
            return "".join([*out, t[at:]])
        return pd.Series([one(t, s) for t, s in zip(text, spans)])

    return with_length(joined.withColumn("text", mask(F.col("text"), F.col(more))).select(*docs.columns))
