"""Secret scans: a trigram inverted index over texts, Boolean trigram queries from the rules, verified matches.

Everything on the data path is a DataFrame expression. A rule's regular
expression is reduced, once and on the driver, to a Boolean query over letter
trigrams that every match must hold; the index lists, for each of the trigrams
any rule asks for, the texts that hold it; intersecting the postings gives the
texts in which a rule can match at all, and only those are searched with it.
Rules without a mandatory trigram are searched in every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as regex_tree
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the fewest characters of ``group`` (0: the whole match) that count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules, in the order in which spans that start together are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Most strings that a run of a pattern is unfolded to while its trigrams are derived.
UNFOLD = 256


def _strings(node) -> set[str] | None:
    """Lower-cased strings that a piece of a pattern stands for, or None if there are too many."""
    op, value = node
    if op is rc.LITERAL:
        return {chr(value).lower()}
    if op is rc.IN and all(o is rc.LITERAL for o, _ in value):
        return {chr(v).lower() for _, v in value}
    if op is rc.SUBPATTERN:
        return _sequence(value[3])[0]
    if op is rc.BRANCH:
        branches = [_sequence(b)[0] for b in value[1]]
        return None if any(b is None for b in branches) else set().union(*branches)
    if op is rc.MAX_REPEAT and value[1] <= 3:
        body = _sequence(value[2])[0]
        if body is not None:
            out: set[str] = set()
            for n in range(value[0], value[1] + 1):
                out |= {"".join(p) for p in product(body, repeat=n)}
            return out if len(out) <= UNFOLD else None
    return None


def _all_of(a: frozenset, b: frozenset) -> frozenset:
    """Either-or lists of trigram sets: both hold. An option that another one implies is dropped."""
    options = {x | y for x in a for y in b}
    return frozenset(x for x in options if not any(y < x for y in options))


ANYTHING = frozenset([frozenset()])


def _of_strings(strings: set[str]) -> frozenset:
    options = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(x for x in options if not any(y < x for y in options))


def _sequence(nodes) -> tuple[set[str] | None, frozenset]:
    """Strings of a whole sequence (None if too many) and the trigram query of its matches."""
    exact, run, query = True, {""}, ANYTHING
    for node in nodes:
        strings = _strings(node)
        if strings is not None and len(run) * len(strings) <= UNFOLD:
            run = {a + b for a in run for b in strings}
            continue
        exact, query, run = False, _all_of(query, _of_strings(run)), {""}
        if strings is not None:
            run = strings
        elif node[0] is rc.SUBPATTERN:
            query = _all_of(query, _sequence(node[1][3])[1])
        elif node[0] is rc.BRANCH:
            query = _all_of(query, frozenset().union(*[_sequence(b)[1] for b in node[1][1]]))
        elif node[0] is rc.MAX_REPEAT and node[1][0] > 0:
            query = _all_of(query, _sequence(node[1][2])[1])
    return (run if exact else None), _all_of(query, _of_strings(run))


def trigram_query(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of lower-case trigrams, one of which every match of ``pattern`` holds whole.

    Empty if some match needs none, so that the rule has to be searched everywhere.
    """
    options = _sequence(list(regex_tree.parse(pattern)))[1]
    return () if frozenset() in options else tuple(sorted(options, key=sorted))


def trigram_index(texts: DataFrame, key: Column, text: Column, trigrams: list[str]) -> DataFrame:
    """Postings ``(trigram, key)``: the distinct keys of texts that hold each of ``trigrams``, letter case aside."""
    lower = F.lower(text)
    held = F.filter(F.array(*[F.when(F.contains(lower, F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return texts.select(key.alias("key"), F.explode(held).alias("trigram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, tuple[frozenset[str], ...]]) -> DataFrame:
    """``(key, <kind>...)``: for each text of the postings, which rules' trigram queries hold."""
    held = postings.groupBy("key").agg(F.collect_set("trigram").alias("held"))  # at most all trigrams of the rules
    test = {
        kind: F.exists(
            F.array(*[F.array(*[F.lit(t) for t in sorted(option)]) for option in options]),
            lambda option: F.size(F.array_intersect(option, F.col("held"))) == F.size(option),
        )
        for kind, options in queries.items()
    }
    found = held.select("key", *[c.alias(kind) for kind, c in test.items()])
    return found.where(" or ".join(f"`{kind}`" for kind in queries))


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of a rule's leftmost non-overlapping matches: code points, end exclusive."""
    gap_then_match = F.lit(r"(?s)\G(.*?)(?:" + rule.pattern + ")")
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.regexp_extract_all(text, gap_then_match, F.lit(1))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    sizes = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    sizes = F.zip_with(sizes, counted, lambda s, c: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(c).alias("counted")))
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    walked = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), nothing.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["size"]).alias("at"),
            F.when(
                m["counted"] >= rule.least,
                F.array_append(acc["spans"], F.struct(
                    (acc["at"] + m["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                    (acc["at"] + m["gap"] + m["size"]).alias("end"),
                )),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return walked["spans"]


def _hint(rule: Rule) -> str:
    """A cheap pattern that every text with a counted match of a whole-match rule of one repeated class holds."""
    nodes = list(regex_tree.parse(rule.pattern))
    if rule.group == 0 and len(nodes) == 1 and nodes[0][0] is rc.MAX_REPEAT and rule.pattern.endswith("+"):
        return f"{rule.pattern[:-1]}{{{rule.least},}}"
    return rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` and a column ``secret_spans``: array of (start, rank, kind, end), by start, then by the order of the rules.

    Whole texts are searched; a null text counts as empty and has no span. Rows
    are neither dropped nor merged: the index and its candidates are keyed by
    the hash of a text, so repeated rows and ids, null ids and further columns
    pass through unchanged. Names that begin with ``secret_`` are this
    operator's own and are replaced if present.
    """
    docs = docs.drop("secret_spans", "secret_key", *[f"secret_{r.kind}" for r in rules])
    text = text_or_empty(text_col)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    keyed = docs.withColumn("secret_key", F.xxhash64(text))
    if queries:
        grams = sorted({t for q in queries.values() for option in q for t in option})
        found = candidates(trigram_index(docs, F.xxhash64(text), text, grams), queries)
        found = found.select(F.col("key").alias("secret_key"), *[F.col(k).alias(f"secret_{k}") for k in queries])
        keyed = keyed.join(found, "secret_key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    per_rule = []
    for rank, rule in enumerate(rules):
        possible = F.col(f"secret_{rule.kind}") if rule.kind in queries else F.rlike(text, F.lit(_hint(rule)))
        per_rule.append(F.when(F.coalesce(possible, F.lit(False)), _spans(rule, rank, text)).otherwise(none))
    spans = F.array_sort(F.concat(*per_rule))
    return keyed.withColumn("secret_spans", spans).select(*docs.columns, "secret_spans")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and span lists of scanned rows."""
    spans = F.col("secret_spans")
    listed = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        F.col(id_col), count("assign"), count("access"), count("hex"), listed.alias("spans")
    ).withColumn("base_sha256", F.sha2(F.col("spans").cast("binary"), 256))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; overlapping spans are replaced together."""
    scanned = scan(docs, rules, text_col)
    text = F.col(text_col)
    spans = F.col("secret_spans")
    clean = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    kept = [F.when(F.size(spans) > 0, clean).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return scanned.select(*kept)
