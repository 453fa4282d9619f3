"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query of trigrams that every match must contain.
The postings (trigram, row) of those trigrams are built from the lower-cased texts and stored by
trigram. A query intersects and unites posting lists; only its candidates are verified by the
expression. A rule without mandatory trigrams (a run of hexadecimal digits) scans every text
where it is read.

How it scales. Posting lists hold row keys only. Texts of rows that are no candidate are never
shuffled: a bitmap of fixed size, one row that is broadcast and tested inside the join, lets them
go first. Of repeated rows each is a candidate of its own, dealt by its key. Positions are code
points. The matches of an expression and the parts between them give the starts, so no Python
code touches a text. Defined results: null is the empty text; very long texts are scanned whole;
repeated rows give repeated results; an extra column of any name is left out; an empty table gives
no rows.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import store


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


# Kinds and patterns.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("forge", r"ghp_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigram_query(regex: str):
    """('and' | 'or', parts), a trigram (lower case), or True where nothing is mandatory."""

    def both(kind: str, parts: list):
        if kind == "or" and any(p is True for p in parts):
            return True
        flat = list(dict.fromkeys(p for p in parts if p is not True))
        return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))

    def walk(seq):
        parts, run = [], ""

        def close():
            nonlocal run
            parts.extend(run[i : i + 3] for i in range(len(run) - 2))
            run = ""

        for op, arg in seq:
            if op is sre.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            close()
            if op is sre.SUBPATTERN:
                parts.append(walk(arg[-1]))
            elif op is sre.BRANCH:
                parts.append(both("or", [walk(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(walk(arg[2]))
        close()
        return both("and", parts)

    return walk(parser.parse(regex))


def _trigrams(q) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(_trigrams, q[1]))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram number, row_key) for every row of (row_key, text) that contains the trigram in either case."""
    low = rows.select("row_key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("row_key", F.explode(found).alias("trigram"))


def matching(index: DataFrame, query, number: dict[str, int], held: dict[int, int]) -> DataFrame:
    """Row keys whose posting lists satisfy a Boolean query; ``held`` is the length of each list.

    Lists of an 'and' are intersected from the shortest one on.
    """
    if isinstance(query, str):
        return index.where(F.col("trigram") == number[query]).select("row_key")

    def size(q) -> int:
        return held.get(number[q], 0) if isinstance(q, str) else (min if q[0] == "and" else sum)([size(x) for x in q[1]])

    parts = [matching(index, x, number, held) for x in sorted(query[1], key=size)]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(x, "row_key", "left_semi") if query[0] == "and" else out.unionByName(x)
    return out if query[0] == "and" else out.distinct()


#: Longs of the bitmap of candidates: 2 MB.
BITMAP = 1 << 18


def _bitmap(keys: DataFrame) -> DataFrame:
    """One row, (bits, one): an array of BITMAP longs with a bit for the lowest bits of each row_key."""
    at = lambda c: F.col(c).bitwiseAND(F.lit(BITMAP * 64 - 1))
    some = keys.select(F.shiftright(at("row_key"), 6).alias("word"), F.expr("shiftleft(1L, cast(row_key & 63 as int))").alias("bit"))
    words = some.unionByName(keys.sparkSession.range(BITMAP).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit")))
    words = words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    bits = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])  # always BITMAP of them
    return words.agg(bits.alias("bits"), F.lit(1).cast("long").alias("one"))


_KIND = "array<struct<start:int,end:int,order:int>>"


def _spans(rule: Rule, order: int) -> Column:
    """array<struct<start, end, order>> of a rule's matches in ``text`` that are long enough."""
    rx = F.lit(rule.regex)
    hit, part = F.regexp_extract_all("text", rx, F.lit(0)), F.split("text", rule.regex, -1)
    size = F.regexp_extract_all("text", rx, F.lit(rule.group)) if rule.group else hit
    lengths = F.zip_with(F.zip_with(hit, F.slice(part, 1, F.size(hit)), lambda h, p: F.struct(F.length(h).alias("h"), F.length(p).alias("p"))), size, lambda x, s: F.struct(x["h"].alias("h"), x["p"].alias("p"), F.length(s).alias("s")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_KIND).alias("out"))

    def step(a, x):
        start = a["at"] + x["p"]
        row = F.array(F.struct(start.alias("start"), (start + x["h"]).alias("end"), F.lit(order).alias("order")))
        return F.struct((start + x["h"]).alias("at"), F.when(x["s"] >= rule.least, F.concat(a["out"], row)).otherwise(a["out"]).alias("out"))

    return F.aggregate(lengths, begin, step, lambda a: a["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found: array<struct<start, end, order>> in order of start and rule, for every row."""
    queries = [trigram_query(r.regex) for r in rules]
    grams = sorted(set().union(*map(_trigrams, queries)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    none = F.array().cast(_KIND)
    full = [i for i, q in enumerate(queries) if q is True]
    seen = F.flatten(F.array(none, *[F.when(F.col("text").rlike(rules[i].regex), _spans(rules[i], i)).otherwise(none) for i in full]))
    number = {g: i for i, g in enumerate(grams)}
    index = store(postings(rows, grams).distinct().repartition("trigram", F.pmod("row_key", F.lit(64))).sortWithinPartitions("trigram"), "postings") if grams else None
    held = {r[0]: r[1] for r in index.groupBy("trigram").count().collect()} if grams else {}  # one row for each trigram
    wanted = None
    for i, q in enumerate(queries):
        if q is not True:
            one = matching(index, q, number, held).select("row_key", F.lit(1 << i).alias("wanted"))
            wanted = one if wanted is None else wanted.unionByName(one)
    if wanted is None:
        return rows.select("doc_id", _ordered(seen).alias("found"))
    wanted = store(wanted.groupBy("row_key").agg(F.expr("bit_or(wanted)").alias("wanted")), "candidates")
    bits = F.broadcast(store(_bitmap(wanted), "bitmap"))
    word = F.shiftright(F.col("row_key").bitwiseAND(F.lit(BITMAP * 64 - 1)), 6).cast("int")
    hit = F.get("bits", word).bitwiseAND(F.expr("shiftleft(1L, cast(row_key & 63 as int))")) != 0
    # every row meets the one row of bits; only rows whose bit is set go on with their texts
    met = (F.pmod("row_key", F.lit(1).cast("long")) + 1 == F.col("one")) & hit
    asked, clear = (rows.join(bits, met, how) for how in ("left_semi", "left_anti"))
    asked = asked.join(wanted, "row_key", "left").select("doc_id", "text", F.coalesce("wanted", F.lit(0)).alias("wanted"), seen.alias("found"))
    more = [F.when((F.col("wanted").bitwiseAND(F.lit(1 << i)) != 0) & F.col("text").rlike(r.regex), _spans(r, i)).otherwise(none) for i, r in enumerate(rules) if i not in full]
    verified = asked.select("doc_id", _ordered(F.flatten(F.array("found", *more))).alias("found"))
    return verified.unionByName(clear.select("doc_id", _ordered(seen).alias("found")))


def _ordered(found: Column) -> Column:
    return F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"))))


def spelled(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"], s["end"])), ",")
