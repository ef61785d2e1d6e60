"""Secret scanning with a trigram inverted index, DataFrame operations only.

From each rule's regular expression a Boolean query of mandatory trigrams is
derived (an AND of ORs of conjunctions, over the lower-cased text).

* Documents are numbered as they are read, ``SEGMENT`` to a segment, and stored
  in a table bucketed by segment; each task writes its own segments, so no text
  is shuffled.
* The inverted index holds, for each trigram that a rule asks for and each
  segment, the posting list as words of 64 bits, one bit for a document; it is
  stored in order of trigram.  It is an aggregate within buckets.
* A rule's query is evaluated on the posting lists: intersections and unions
  are AND and OR of their words.  What remains are the rule's candidates.
* The candidates' bits, a row for each segment, join the documents bucket by
  bucket, again without a shuffle of texts, and only candidates are scanned
  with the rule's expression.  Rules without a mandatory trigram (a run of hex
  digits) scan every text.

Spans count code points, end exclusive.  They come from the texts between
matches (``split``) and the matches (``regexp_extract_all``), which scan
leftmost and without overlap; their running sums are taken in blocks of about
the square root of their number, so a text may hold many thousand matches.

Defined cases: null text is empty and has no spans; an empty table gives no
rows; repeated rows each give a row; extra columns are ignored; kinds keep
their listed order on ties.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._work import stored, work_dir

#: Documents of a segment.
SEGMENT = 512


@dataclass(frozen=True)
class Rule:
    """``keep`` is a further expression that a match must satisfy (None: all do)."""

    kind: str
    pattern: str
    keep: str | None = None
    base: bool = False


#: Fixed patterns of the base kinds, as asked for; a failing match is dropped
#: after the scan.  The {n,} forms equal the + forms with that length test,
#: since a run that is too short holds no longer one.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$""", True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", None, True),
    Rule("hex", r"[0-9a-f]{16,}", None, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("live", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
)


def _literals(node, limit: int = 32) -> list[tuple[set[str], bool]]:
    """Pieces of a parsed expression: (possible strings, whether they're all of it)."""
    out: list[tuple[set[str], bool]] = []
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            out.append(({chr(arg).lower()}, True))
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= 8:
            out.append(({chr(v).lower() for _, v in arg}, True))
        elif name == "SUBPATTERN":
            out += _literals(arg[3], limit)
        elif name == "BRANCH":
            words = [_words(_literals(b, limit), limit) for b in arg[1]]
            out.append((set().union(*words), True) if all(w is not None for w in words) else (set(), False))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, sub = arg
            inner = _words(_literals(sub, limit), limit)
            if inner is not None and (least, most) == (0, 1):
                out.append((inner | {""}, True))
            elif inner is not None and least == most and least <= 8 and len(inner) == 1:
                out.append(({next(iter(inner)) * least}, True))
            else:
                out.append((set(), False))
        else:
            out.append((set(), False))
    return out


def _words(pieces: list[tuple[set[str], bool]], limit: int) -> set[str] | None:
    """All strings that the pieces spell, or None if they are not a small set."""
    words = {""}
    for strings, exact in pieces:
        if not exact or len(words) * len(strings) > limit:
            return None
        words = {a + b for a, b in product(words, strings)}
    return words


def trigram_query(pattern: str, limit: int = 32) -> list[list[list[str]]]:
    """AND of groups; a group is an OR of conjunctions of trigrams.  Empty: none mandatory."""
    pieces = _literals(re._parser.parse(pattern), limit)
    groups, run = [], []
    for piece in [*pieces, (set(), False)]:
        if piece[1] and _words([*run, piece], limit) is not None:
            run.append(piece)
            continue
        words = _words(run, limit) or set()
        if words and all(len(w) >= 3 for w in words):
            needs = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words}
            # A or (A and B) is A
            groups.append(sorted(sorted(a) for a in needs if not any(b < a for b in needs)))
        run = [piece] if piece[1] else []
    return groups


def asked_trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for g in trigram_query(r.pattern) for c in g for t in c})


def postings(low: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The trigrams of a lower-cased text that the rules ask for."""
    asked = asked_trigrams(rules)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in asked])) if asked else F.array().cast("array<string>")


def _bucketed(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """``rows`` as a table in the shared folder, bucketed by its column ``segment``."""
    spark = rows.sparkSession
    table = f"ledgerline_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "zstd").option("path", f"{work_dir(spark)}/{name}").bucketBy(buckets, "segment").saveAsTable(table)
    return spark.table(table)


@dataclass(frozen=True)
class Index:
    """``docs (doc_id, text, segment, place)`` and their posting lists ``(trigram, segment, word, bits)``."""

    docs: DataFrame
    lists: DataFrame
    buckets: int


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> Index:
    """Numbers and stores the documents ``(doc_id, text)``, and stores the posting lists of the asked trigrams."""
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()  # by input partition; fixed once it's stored
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at.alias("at"))
    rows = rows.select("doc_id", "text", F.expr(f"at div {SEGMENT}").alias("segment"), F.expr(f"cast(at % {SEGMENT} as int)").alias("place"))
    table = _bucketed(rows, "documents", buckets)
    # a column of its own: the text is lower-cased once, not for each trigram
    low = table.select("segment", "place", F.lower("text").alias("low"))
    marks = low.select("segment", "place", F.explode(postings(F.col("low"), rules)).alias("trigram"))
    lists = marks.groupBy("segment", "trigram", F.expr("cast(place div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits"))
    return Index(table, stored(lists.sortWithinPartitions("trigram", "segment", "word").select("trigram", "segment", "word", "bits"), "postings"), buckets)


def candidates(index: Index, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(segment, word, <kind>...): for each rule with a query the bits of its candidates, by AND and OR of posting lists."""
    bits = {t: f"t{i}" for i, t in enumerate(asked_trigrams(rules))}
    none = F.lit(0).cast("long")
    lists = index.lists.groupBy("segment", "word").agg(F.lit(1).alias("one"), *[F.coalesce(F.expr(f"bit_or(if(trigram = '{t.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', bits, null))"), none).alias(c) for t, c in bits.items()])

    def met(rule: Rule) -> Column:
        every = F.lit(-1).cast("long")
        for group in trigram_query(rule.pattern):
            some = none
            for all_of in group:
                both = F.lit(-1).cast("long")
                for t in all_of:
                    both = both.bitwiseAND(F.col(bits[t]))
                some = some.bitwiseOR(both)
            every = every.bitwiseAND(some)
        return every

    asked = [r for r in rules if trigram_query(r.pattern)]
    return lists.select("segment", "word", *[met(r).alias(r.kind) for r in asked]).where(reduce(lambda a, b: a | b, [F.col(r.kind) != 0 for r in asked], F.lit(False)))


def candidate_documents(index: Index, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``index.docs`` with ``kinds``: the rules to scan each document with."""
    asked = [r.kind for r in rules if trigram_query(r.pattern)]
    if not asked:
        return index.docs.select("doc_id", "text", F.array(*[F.lit(r.kind) for r in rules]).cast("array<string>").alias("kinds"))
    found = candidates(index, rules).select("segment", F.struct("word", F.struct(*asked).alias("bits")).alias("x"))
    # SEGMENT / 64 words at most
    words = found.groupBy("segment").agg(F.map_from_entries(F.collect_list("x")).alias("words"))
    words = _bucketed(words.repartition(index.buckets, "segment"), "candidates", index.buckets)
    both = index.docs.join(words.hint("shuffle_hash"), "segment", "left").withColumn("mine", F.try_element_at("words", F.expr("cast(place div 64 as int)")))
    bit = lambda kind: F.coalesce(F.call_function("getbit", F.col("mine")[kind], F.expr("place % 64")), F.lit(0).cast("tinyint")) == 1
    return both.select("doc_id", "text", F.array_compact(F.array(*[F.when(bit(r.kind) if r.kind in asked else F.lit(True), F.lit(r.kind)) for r in rules])).alias("kinds"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(steps: Column) -> Column:
    """The sum of all entries before each entry of an array, in blocks of its root."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blocks(steps: Column, width: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / width).cast("int")), lambda j: total(F.slice(steps, F.lit(1), j * width)))

        def place(_: Column, i: Column, before: Column) -> Column:
            block = F.floor(i / width).cast("int")
            return F.get(before, block) + total(F.slice(steps, block * width + 1, i - block * width))

        return _bound(before, lambda b: F.transform(steps, lambda x, i: place(x, i, b)))

    return _bound(steps, lambda s: _bound(F.greatest(F.ceil(F.sqrt(F.size(s))).cast("int"), F.lit(1)), lambda w: blocks(s, w)))


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place, kind, end, match) of a rule's matches in a text."""
    item = "struct<start:int,place:int,kind:string,end:int,match:string>"
    pieces = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hits"))

    def walk(p: Column) -> Column:
        gap = lambda i: F.char_length(F.get(p["gaps"], i))
        steps = F.transform(p["hits"], lambda h, i: gap(i) + F.char_length(h))
        return _bound(_starts(steps), lambda at: F.transform(p["hits"], lambda h, i: F.struct(
            (F.get(at, i) + gap(i)).alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"),
            (F.get(at, i) + gap(i) + F.char_length(h)).alias("end"), h.alias("match"),
        )))

    walked = _bound(pieces, walk)
    kept = F.filter(walked, lambda s: s["match"].rlike(rule.keep)) if rule.keep else walked
    return F.when(F.rlike(text, F.lit(rule.pattern)), kept.cast(f"array<{item}>")).otherwise(F.array().cast(f"array<{item}>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): spans sorted by start, then by the rules' order."""
    found = candidate_documents(build_index(docs, rules), rules)
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int,match:string>>")
    parts = [F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return found.select("doc_id", F.array_sort(F.flatten(F.array(*parts))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans) per row."""
    base = [r.kind for r in rules if r.base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs, rules).select(
        "doc_id", *[count(k) for k in base],
        F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
