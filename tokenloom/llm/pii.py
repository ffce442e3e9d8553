"""Operator 9: personal data by patterns and by what the corpus discloses, DataFrame functions only.

Patterns find the base spans: email addresses, IP addresses, card numbers and phone numbers. Each
distinct value is a protected entity. A word of its documents discloses it by the pointwise mutual
information of word and entity over the documents of the corpus, set against the entity's own
information (the public C-sanitisation rule): at a ratio of ``disclosure`` or more the word gives
the entity away, and its places outside base spans are spans too. At 1 these are the words that never
occur without the entity. All counts are of whole documents.

Rare entities are a matter of statistics: a word counts only if its meeting the entity so often would
be chance with a probability below ``chance`` over all pairs of word and entity together (Hoeffding's
bound for draws without replacement). Words of fewer than three letters are not judged.

Defined results: null text is like the empty text and has no span; a text is never cut; rows that
repeat an id are judged each for itself, and count as documents of their own; an entity in every
document has no information and discloses nothing; an empty table gives an empty one. Only the id
and the text are read, so other columns do no harm, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import join_checked, materialize

KINDS = ["email", "ip", "card", "phone"]
TERM = len(KINDS)
LABELS = [*KINDS, "term"]

# The contract's patterns, written so that no text takes more than linear time: runs are possessive,
# and a match may begin inside a run only where the last one ended (\G). Card runs of other lengths
# are left out at once; they are whole runs, so nothing else can match inside them.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = [
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
]
NEEDED = ["@", ".", None, "+"]  # a text without this has no match
WORD = r"\p{L}{3,}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Check digit rule of card numbers, for a string of digits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    weighted = F.transform(
        values, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9)
    )
    return F.aggregate(weighted, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.length(_digits(value))
    octets = F.forall(
        F.split(value, r"\."),
        lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
        & (F.right(p, F.lit(4)).cast("int") <= 255),
    )
    return (
        F.when(kind == 0, True)
        .when(kind == 1, octets)
        .when(kind == 2, luhn(_digits(value)))
        .otherwise(digits.between(9, 15))
    )


def _pieces(text: Column, pattern: str) -> Column:
    """Matches with the length of the text between each and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.zip_with(
        found,
        F.slice(gaps, 1, F.size(found)),
        lambda m, g: F.struct(m.alias("value"), g.alias("gap")),
    )
    return F.when(F.size(found) > 0, zipped)


def _placed(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` of ``by, nth, piece`` with the places of the matches in code points."""
    size = F.length("piece.value")
    run = F.sum(F.col("piece.gap") + size).over(Window.partitionBy(*by).orderBy("nth"))
    return rows.select(
        *by, F.col("piece.value").alias("value"), (run - size).alias("start"), run.alias("end")
    )


def base_spans(docs: DataFrame, text: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """A written table of all rows (``row, id``; ``text`` of those with a match) and the valid base
    spans (``row, kind, start, end, value``)."""
    whole = F.col(text)
    found = [
        F.when(whole.contains(need) if need else F.lit(True), _pieces(whole, pattern)).alias(f"m{k}")
        for k, (pattern, need) in enumerate(zip(PATTERNS, NEEDED))
    ]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(row_id).alias("id"),
        whole.alias("text"),
        *found,
    )
    some = F.greatest(*[F.coalesce(F.size(f"m{k}"), F.lit(0)) for k in range(len(KINDS))]) > 0
    rows = materialize(rows.withColumn("text", F.when(some, F.col("text"))), "pattern-matches")
    each = None
    for k in range(len(KINDS)):
        one = rows.where(f"m{k} is not null").select(
            "row", F.lit(k).alias("kind"), F.posexplode(f"m{k}").alias("nth", "piece")
        )
        each = one if each is None else each.union(one)
    placed = _placed(each, "row", "kind").where(valid(F.col("kind"), F.col("value")))
    return rows, materialize(placed, "base-spans")


def _entities(spans: DataFrame) -> DataFrame:
    """Spans with the entity each stands for: letters in lower case, numbers by their digits."""
    plain = F.when(F.col("kind") < 2, F.lower("value")).otherwise(_digits(F.col("value")))
    return spans.withColumn("entity", F.concat_ws(":", F.col("kind").cast("string"), plain))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _outside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``row, outside, words``: distinct words that occur outside the spans, and all, of rows with one."""
    lists = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    cut = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).cast("long").alias("at"),
            F.concat(
                acc["out"],
                F.lit(" "),
                F.substring("text", (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")),
            ).alias("out"),
        ),
    )
    cut = rows.where("text is not null").join(lists, "row").select("row", "text", cut.alias("cut"))
    rest = F.expr("concat(cut.out, ' ', substring(text, cast(cut.at as int) + 1))")
    return cut.select("row", _words(rest).alias("outside"), _words(F.col("text")).alias("words"))


def _unlikely(both: Column, one: Column, other: Column, total: Column) -> Column:
    """Logarithm of a bound on the probability that ``other`` documents of ``total``, drawn by chance,
    hit ``both`` or more of ``one``."""
    share, usual = both / one, other / total
    missed = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual))).otherwise(0.0)
    return F.when(share > usual, -one * (share * F.log(share / usual) + missed)).otherwise(0.0)


def disclosing(docs: DataFrame, rows: DataFrame, spans: DataFrame, text: str, disclosure: float, chance: float) -> DataFrame:
    """``row, term``: words that give away an entity of their row."""
    held = materialize(_entities(spans).select("row", "entity").distinct(), "row-entities")
    n_entity = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    words = materialize(_outside(rows, spans), "entity-row-words")
    each = held.join(words.select("row", F.size("words").alias("size")), "row")
    tests = each.agg(F.sum("size")).first()[0] or 0
    total = float(rows.count())
    level = math.log(chance / max(tests, 1))
    # The bound is least if word and entity never occur apart; entities too rare for that are done.
    least = _unlikely(F.col("n_entity"), F.col("n_entity"), F.col("n_entity"), F.lit(total))
    n_entity = n_entity.where((F.col("n_entity") < total) & (least < level))
    n_entity = materialize(n_entity, "entities")
    mine = held.join(n_entity.select("entity"), "entity").join(words, "row")
    mine = mine.select(
        "entity",
        F.explode(
            F.concat(
                F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(1).alias("all"))),
                F.transform("outside", lambda w: F.struct(w.alias("term"), F.lit(0).alias("all"))),
            )
        ).alias("w"),
    )
    pairs = mine.groupBy("entity", "w.term").agg(
        F.sum("w.all").alias("n_both"), F.min("w.all").alias("inside")
    )
    pairs = materialize(pairs.where("inside = 0").drop("inside"), "word-entity-counts")
    judged = materialize(pairs.select("term").distinct(), "judged-words")
    # All words are counted before the join: a judged word may be a common one, and its places would
    # be most of the corpus, while its count is one row.
    n_term = docs.select(F.explode(_words(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    n_term = n_term.join(judged, "term")
    told = pairs.join(n_term, "term").join(n_entity, "entity")
    information = F.log2(total / F.col("n_entity"))
    mutual = F.log2(total * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    both, one, other = F.col("n_both"), F.col("n_entity"), F.col("n_term")
    rare = F.least(_unlikely(both, one, other, F.lit(total)), _unlikely(both, other, one, F.lit(total)))
    told = told.where((mutual >= disclosure * information - 1e-9) & (rare < level))
    told = materialize(told.select("entity", "term"), "disclosing-words")
    some = held.join(told.select("entity").distinct(), "entity").join(words.select("row", "outside"), "row")
    some = some.select("row", "entity", F.explode("outside").alias("term"))
    return join_checked(some, told, ["entity", "term"]).select("row", "term").distinct()


def find(
    docs: DataFrame,
    disclosure: float = 0.8,
    chance: float = 0.05,
    text: str = "text",
    row_id: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """All rows (``row, id``; ``text`` of those with a base match), and all spans as written tables:
    ``row, kind, start, end``, kinds as in ``LABELS``."""
    rows, base = base_spans(docs, text, row_id)
    told = materialize(disclosing(docs, rows, base, text, disclosure, chance), "told-words")
    texts = rows.join(told.select("row").distinct(), "row").select("row", "text")
    words = texts.select("row", F.posexplode(_pieces(F.col("text"), WORD)).alias("nth", "piece"))
    words = _placed(words, "row").withColumn("term", F.lower("value"))
    terms = words.join(told, ["row", "term"]).select("row", F.lit(TERM).alias("kind"), "start", "end")
    known = base.select("row", F.col("start").alias("from"), F.col("end").alias("to"))
    over = (terms["row"] == known["row"]) & (F.col("start") < F.col("to")) & (F.col("end") > F.col("from"))
    terms = terms.join(known, over, "left_anti")
    spans = base.select("row", "kind", "start", "end").union(terms)
    return rows, materialize(spans, "spans")


def report(docs: DataFrame, disclosure: float = 0.8, chance: float = 0.05, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: its id, ``n_`` of every base kind, and the sorted ``spans`` (kind, start, end)."""
    rows, spans = find(docs, disclosure, chance, text, row_id)
    lists = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    out = rows.select("row", F.col("id").alias(row_id)).join(lists, "row", "left").drop("row")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    out = out.withColumn("spans", F.coalesce("spans", none))
    for k, name in enumerate(KINDS):
        out = out.withColumn(f"n_{name}", F.size(F.filter("spans", _of(k))).cast("long"))
    return out


def _of(kind: int):
    return lambda span: span["kind"] == kind


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, LABELS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def sanitise(docs: DataFrame, disclosure: float = 0.8, chance: float = 0.05, remove: bool = False, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``row_id, text`` with every span generalised to its kind in brackets, or removed.

    Spans that overlap are one, of the first one's kind. Rows are numbered once, in a written table
    that both the search and the result read, so a text and its spans stay together however the rows
    of ``docs`` fall from one reading to the next.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("n"), F.col(row_id).alias("id"), F.col(text).alias("text"))
    numbered = materialize(numbered, "numbered-texts")
    rows, spans = find(numbered, disclosure, chance, "text", "n")
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", (F.coalesce(before, F.lit(-1)) <= F.col("start")).cast("int"))
    part = fresh.withColumn("part", F.sum("fresh").over(order))
    whole = part.groupBy("row", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", "start").alias("kind")
    )
    lists = whole.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    names = F.array(*[F.lit("" if remove else f"[{x.upper()}]") for x in LABELS])
    hidden = F.concat(
        F.array_join(
            F.transform(
                F.col("s"),
                lambda s, i: F.concat(
                    F.substring(
                        "text",
                        F.when(i == 0, 0).otherwise(F.col("s")[i - 1]["end"]).cast("int") + 1,
                        (s["start"] - F.when(i == 0, 0).otherwise(F.col("s")[i - 1]["end"])).cast("int"),
                    ),
                    F.element_at(names, s["kind"] + 1),
                ),
            ),
            "",
        ),
        F.expr("substring(text, cast(s[size(s) - 1].end as int) + 1)"),
    )
    changed = rows.join(lists, "row").select(F.col("id").alias("n"), hidden.alias("hidden"))
    return numbered.join(changed, "n", "left").select(
        F.col("id").alias(row_id), F.coalesce("hidden", "text").alias(text)
    )
