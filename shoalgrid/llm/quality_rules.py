"""Quality rules: base counts and distribution divergence (DataFrame functions only).

Every document gets two histograms: character classes, and common words. Each is compared with the same histogram of
every language's reference (all its documents that pass the base rules and hold few symbols, pooled) by the Jensen-Shannon distance, base 2, and the nearest
language counts, so that a wrong tag among them or a missing one doesn't matter. Documents shorter than the guards get no verdict
from that histogram, as short texts are far from any reference by chance; nor do documents tagged with a language that has no reference.

References come from the table that is judged unless they are given: language_references() of one table can be kept and used for all others, so that a document's verdict doesn't depend on
its neighbours. A table without any document of a known language has one reference, pooled from all its documents.

Defined cases: a null text has no words; a null language tag is compared with all references; of references that are equally near either gives the same distance; very long texts are read whole; null, unknown or clashing columns
beside doc_id, text and lang are carried or ignored; repeated rows are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.common import let, materialize, table, words

SYMBOLS = "#*$%&|<>"
CLASSES = (
    "bcdfghjklmnpqrstvwxyz",
    "aeiou",
    SYMBOLS,
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    ".,;:?'\"()-",
    "!",
)
#: Frequent function words of each supported language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "on", "with"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "für", "auf"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}
VOCABULARY = tuple(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))
LANGUAGES = tuple(COMMON_WORDS)
#: The reference of a table without documents of these languages.
ANY = "*"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Documents with more symbols per 100 words don't count in the language references.
    max_reference_symbols: int = 2
    window: int = 5
    #: Minimum-length guards of the two histograms.
    min_chars: int = 600
    min_common_base: int = 60
    #: Jensen-Shannon distances (0 to 1) above which a document is rejected.
    max_class_distance: float = 0.2
    max_word_distance: float = 0.4


def _repeat_words(w: Column, window: int) -> Column:
    """Words covered by windows that the same text holds twice or more. w: a column, not an expression."""
    n = F.size(w) - window + 1
    hashes = let(w, lambda a: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[a[i + k] for k in range(window)])))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(a: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(a, j)["h"] == F.get(a, k)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.sort_array(F.transform(twice, lambda j: a[j]["i"]))

        return F.aggregate(
            let(ranked, starts),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda s, p: F.struct((s["n"] + window - F.greatest(F.lit(0), s["end"] - p)).alias("n"), (p + window).alias("end")),
            lambda s: s["n"],
        )

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 2, F.lit(0)).otherwise(found).cast("long")


def document_statistics(docs: DataFrame, rules: Rules = Rules(), carry: bool = False) -> DataFrame:
    """Per document: doc_id, lang, the base counts, and the two histograms as arrays of counts; with carry, the whole row as row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(F.col("doc_id"), F.col("lang"), F.coalesce("text", F.lit("")).alias("_t"), *[row] * carry)
    base = base.withColumn("_w", words(F.col("_t")))
    base = base.withColumn("_s0", F.array_join("_w", "")).withColumn("_common", F.filter("_w", lambda x: x.isin(*VOCABULARY)))
    # Each pass takes one class of characters away, the most frequent first, so the later ones are short.
    for k, chars in enumerate(CLASSES):
        pattern = "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]+"
        base = base.withColumn(f"_s{k + 1}", F.regexp_replace(f"_s{k}", pattern, ""))
    left = [F.length(f"_s{k}") for k in range(len(CLASSES) + 1)]
    counts = [(a - b).cast("long") for a, b in zip(left, left[1:], strict=False)]
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hits = [(F.size("_common") - F.size(F.array_remove("_common", w))).cast("long") for w in VOCABULARY]
    n = F.size("_w").cast("long")
    return base.select(
        "doc_id",
        "lang",
        n.alias("n_words"),
        left[0].cast("long").alias("word_chars"),
        counts[CLASSES.index(SYMBOLS)].alias("n_symbols"),
        F.when(F.instr("_t", "\n") == 0, F.lit(0)).otherwise(let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w"), rules.window).alias("n_repeat_words"),
        F.array(*counts, left[-1].cast("long"), (F.length("_t") - left[0]).cast("long")).alias("classes"),
        F.array(*hits, n - F.size("_common")).alias("commons"),
        *["row"] * carry,
    )


def base_failed(rules: Rules) -> Column:
    n = F.col("n_words")
    return (n < rules.min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(rules.max_repeat_percent) * n)


def language_references(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: for each of the LANGUAGES that the table has, its pooled histograms as shares; ANY's where it has none. At most len(LANGUAGES) entries."""
    size = len(CLASSES) + 2, len(VOCABULARY) + 1
    few = F.lit(100) * F.col("n_symbols") <= F.lit(rules.max_reference_symbols) * F.col("n_words")
    known = stats.filter(~base_failed(rules) & few).withColumn("lang", F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise(ANY))
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(size[0])] + [F.sum(F.col("commons")[k]).alias(f"w{k}") for k in range(size[1])]
    shares = lambda a: let(F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x), lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))
    pooled = known.groupBy("lang").agg(*sums).select(
        "lang",
        shares(F.array(*[f"c{k}" for k in range(size[0])])).alias("c"),
        shares(F.array(*[f"w{k}" for k in range(size[1])])).alias("w"),
    )
    every = F.sort_array(F.collect_list(F.struct("lang", "c", "w")))
    return pooled.agg(let(every, lambda a: F.when(F.size(a) > 1, F.filter(a, lambda r: r["lang"] != ANY)).otherwise(a)).alias("references"))


def jensen_shannon(counts: Column, shares: Column) -> Column:
    """Distance (square root of the divergence, base 2) between a histogram of counts and one of shares; 0 if the counts are all 0."""
    plog = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def distance(n: Column) -> Column:
        parts = F.zip_with(counts, shares, lambda x, q: let(x / n, lambda p: let((p + q) / F.lit(2.0), lambda m: (plog(p, m) + plog(q, m)) / F.lit(2.0))))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return let(total, lambda n: F.when(n > 0, distance(n)).otherwise(F.lit(0.0)))


def judged(docs: DataFrame, rules: Rules = Rules(), carry: bool = False, references: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, both distances to the nearest reference and the verdict (with carry, also row); one row per row of docs. references: see language_references()."""
    stats = materialize(document_statistics(docs, rules, carry), "quality-statistics")
    near = lambda h, k: F.array_min(F.transform("references", lambda r: jensen_shannon(F.col(h), r[k])))
    n, chars = F.col("n_words"), F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    failed = base_failed(rules)
    comparable = F.col("lang").isNull() | F.exists("references", lambda r: r["lang"].isin(ANY) | (r["lang"] == F.col("lang")))
    far_classes = (chars >= rules.min_chars) & (F.col("class_distance") > rules.max_class_distance)
    far_words = (n >= rules.min_common_base) & (F.col("word_distance") > rules.max_word_distance)
    return (
        stats.withColumn("references", (references or language_references(stats, rules)).scalar())  # one value, whatever the input
        .withColumn("class_distance", F.coalesce(near("classes", "c"), F.lit(0.0)))
        .withColumn("word_distance", F.coalesce(near("commons", "w"), F.lit(0.0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~(failed | (comparable & (far_classes | far_words))))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"), *["row"] * carry)
    )


def accepted(docs: DataFrame, rules: Rules = Rules(), references: DataFrame | None = None) -> DataFrame:
    """docs without the documents that the rules reject."""
    return judged(docs, rules, True, references).filter("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def oracle(rules: Rules = Rules()) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    classes = ", ".join(f"({k}, {quote(c)})" for k, c in enumerate(CLASSES))
    vocabulary = ", ".join(f"({k}, {quote(w)})" for k, w in enumerate(VOCABULARY))
    return f"""
with d as (select row_number() over () rid, doc_id, lang, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from d),
b as (select rid, doc_id, lang, t, w, len(w) n_words, array_to_string(w, '') s from w),
g as (select rid, i, array_to_string(w[i:i + {rules.window - 1}], ' ') g from (select rid, w, unnest(range(1, n_words - {rules.window - 2})) i from b where n_words >= {rules.window})),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) k from g) where k > 1),
rep as (select rid, count(distinct i + k) n from twice, range({rules.window}) r(k) group by rid),
cls(k, chars) as (values {classes}), voc(k, word) as (values {vocabulary}),
c1 as (select rid, k, cast(length(s) - length(translate(s, chars, '')) as bigint) n from b, cls),
c2 as (select * from c1 union all select rid, {len(CLASSES)}, length(s) - (select coalesce(sum(n), 0) from c1 where c1.rid = b.rid) from b
       union all select rid, {len(CLASSES) + 1}, length(t) - length(s) from b),
w1 as (select rid, voc.k, count(*) n from (select rid, unnest(w) x from b) u join voc on voc.word = u.x group by all),
w2 as (select rid, k, coalesce(n, 0) n from b cross join voc left join w1 using (rid, k)),
w3 as (select * from w2 union all select rid, {len(VOCABULARY)}, n_words - (select coalesce(sum(n), 0) from w2 where w2.rid = b.rid) from b),
h as (select 'c' kind, rid, k, cast(n as bigint) n from c2 union all select 'w', rid, k, cast(n as bigint) from w3),
base as (select rid, doc_id, lang, cast(n_words as bigint) n_words, cast(length(s) as bigint) word_chars, cast(length(s) - length(translate(s, '{SYMBOLS}', '')) as bigint) n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, cast(coalesce(n, 0) as bigint) n_repeat_words, length(t) n_chars
  from (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from b) left join rep using (rid)),
f as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words base_failed from base),
ref0 as (select case when lang in ({", ".join(map(quote, LANGUAGES))}) then lang else '{ANY}' end lang, kind, k, sum(n) n from h join f using (rid) where not base_failed and 100 * n_symbols <= {rules.max_reference_symbols} * n_words group by all),
ref1 as (select * from ref0 where lang <> '{ANY}' or not exists (select 1 from ref0 where lang <> '{ANY}')),
ref as (select lang, kind, k, coalesce(n / nullif(cast(sum(n) over (partition by lang, kind) as double), 0), 0) q from ref1),
p as (select kind, rid, k, n / cast(sum(n) over (partition by kind, rid) as double) p, sum(n) over (partition by kind, rid) total from h),
js as (select rid, kind, lang, sqrt(greatest(0, sum(((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + (case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2))) d
  from p join ref using (kind, k) where total > 0 group by all),
near as (select rid, kind, min(d) d from js group by all),
j as (select f.*, coalesce(c.d, 0) class_distance, coalesce(v.d, 0) word_distance from f left join near c on c.rid = f.rid and c.kind = 'c' left join near v on v.rid = f.rid and v.kind = 'w')
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or (lang is null or lang in (select lang from ref) or '{ANY}' in (select lang from ref)) and ((n_chars >= {rules.min_chars} and class_distance > {rules.max_class_distance}) or (n_words >= {rules.min_common_base} and word_distance > {rules.max_word_distance}))) kept,
  round(class_distance, 6) class_distance, round(word_distance, 6) word_distance from j
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": oracle()}
