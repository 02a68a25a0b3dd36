"""Quality rules by distribution divergence, in DataFrame expressions only.

Each document gives two histograms: characters by class and common words of its language, counted over the corpus (the
last bin: all other words).  The reference of a language is the sum of the histograms of all its
documents.  A document whose Jensen-Shannon distance from its reference is over a threshold is
rejected; texts and languages under a minimum length are judged by the base rules alone.
"""

from __future__ import annotations

import uuid

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import table

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
#: Character classes; what is in none of them is the last bin.
CLASSES = {"space": SPACE, "upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "mark": r"[.,;:!?'\x22()\-]", "beyond": r"[^\x00-\x7F]"}
#: The common words of a language are so many, each at least such a share of all its words.
COMMON_WORDS, COMMON_SHARE = 20, 0.002


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_percent: int = 20
    judged_words: int = 50
    judged_reference_words: int = 1000
    #: A distance may be up to ``most + slack / sqrt(words)``: short texts stray further by chance.
    most_class_distance: float = 0.14
    class_slack: float = 1.3
    most_word_distance: float = 0.08
    word_slack: float = 2.4


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """How many words lie in k-word windows that stand twice or more in the array."""

    def covered(prints: Column) -> Column:
        order = F.array_sort(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spread(o: Column) -> Column:
            twin = F.filter(o, lambda x, i: (F.get(o, i - 1)["h"] == x["h"]) | (F.get(o, i + 1)["h"] == x["h"]))
            at = F.array_sort(F.transform(twin, lambda x: x["i"]))
            return _let(at, lambda a: F.aggregate(F.transform(a, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(a, i + 1) - p, F.lit(k)))), F.lit(0), lambda s, x: s + x))

        return F.when(F.size(F.array_distinct(prints)) < F.size(prints), _let(order, spread)).otherwise(F.lit(0))

    prints = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) > k, _let(prints, covered)).otherwise(F.lit(0)).cast("long")


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = COMMON_WORDS, share: float = COMMON_SHARE) -> DataFrame:
    """(lang, commons): the most frequent words of each language, lower-cased; of equally frequent ones the first by code point.

    Only words over the share are ranked, 1 / share of them a language at most.
    """
    words = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.explode(F.split(F.lower(F.col(text_col)), SPACE + "+")).alias("word")).where("word <> ''")
    counts = table(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "counts")
    whole = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    some = counts.join(whole, "lang").where(F.col("n") >= share * F.col("all"))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "word"))).where(F.col("rank") <= most)
    return some.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("commons"))


def features(docs: DataFrame, commons: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` (without the text; commons: of :func:`common_words`) and _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _classes, _commons, _lang."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    counts = {f"_c_{name}": count(pattern) for name, pattern in CLASSES.items()}
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    lang = F.coalesce(F.col(lang_col), F.lit(""))
    empty = F.array().cast("array<string>")
    key, told_commons = f"lang_{uuid.uuid4().hex}", f"commons_{uuid.uuid4().hex}"
    own = commons.select(F.col("lang").alias(key), F.col("commons").alias(told_commons))
    docs = docs.join(own, lang == F.col(key), "left").drop(key)

    def told(ws: Column, commons: Column) -> Column:
        hits = F.filter(F.transform(ws, lambda w: F.array_position(commons, F.lower(w)).cast("int")), lambda p: p > 0)
        hist = _let(hits, lambda h: F.transform(F.sequence(F.lit(1), F.size(commons)), lambda k: F.size(F.filter(h, lambda p: p == k)).cast("long")))
        rest = lambda h: F.concat(h, F.array(F.size(ws) - F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + x)))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            repeated_words(ws).alias("n_repeat_words"),
            F.when(F.size(commons) > 0, _let(hist, rest)).otherwise(F.array(F.size(ws).cast("long"))).alias("commons"),
        )

    commons = F.coalesce(told_commons, empty)
    out = docs.withColumns({
        **counts,
        "_lang": lang,
        "_length": F.length(text).cast("long"),
        "_told": _let(words, lambda ws: told(ws, commons)),
        "_n_dup_lines": _let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")),
    })
    held = [F.col(c) for c in counts]
    return out.withColumns({
        "_n_words": F.col("_told.n_words"),
        "_n_repeat_words": F.col("_told.n_repeat_words"),
        "_commons": F.col("_told.commons"),
        "_word_chars": F.col("_length") - F.col("_c_space"),
        "_n_symbols": F.col("_c_symbol"),
        "_classes": F.array(*held, F.col("_length") - sum(held[1:], held[0])),
    }).drop(*counts, "_told", "_length", told_commons, text_col)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts of one length; an empty one has no shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x.cast("double"))
    share = lambda h: _let(total(h), lambda t: F.transform(h, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))
    both = F.zip_with(share(p), share(q), lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """``docs`` without its text column, plus the counts of :func:`features`, _class_distance, _word_distance, _base_failed and _kept.

    Null text: no words, so the base rules reject it.  A null language is a language of its own.  Repeated rows are judged
    alike; a distance equal to its limit is kept; very long texts are read whole; an empty table gives an empty result.
    Columns of the names above and _lang, _told, _length, _commons, _classes and _c_* are replaced or dropped.
    """
    commons = table(common_words(docs, text_col, lang_col), "commons")  # of known size, so Spark tells whether it may be broadcast
    rows = table(features(docs, commons, text_col, lang_col), "quality")
    bins = lambda c, n: F.array(*[F.sum(F.get(c, i)) for i in range(n)])
    longest = 1 + COMMON_WORDS
    all_classes, all_commons, all_words = (f"{c}_{uuid.uuid4().hex}" for c in ("classes", "commons", "words"))
    sums = rows.groupBy("_lang").agg(bins("_classes", len(CLASSES) + 1).alias(all_classes), bins("_commons", longest).alias(all_commons), F.sum("_n_words").alias(all_words))
    sums = sums.withColumn(all_commons, F.filter(all_commons, lambda x: x.isNotNull()))
    rows = rows.join(sums, "_lang", "left")
    guarded = (F.col("_n_words") >= rules.judged_words) & (F.col(all_words) >= rules.judged_reference_words)
    rows = rows.withColumns({
        "_class_distance": F.when(guarded, js_distance(F.col("_classes"), F.col(all_classes))),
        "_word_distance": F.when(guarded, js_distance(F.col("_commons"), F.col(all_commons))),
        "_base_failed": (F.col("_n_words") < rules.min_words) | (100 * F.col("_n_repeat_words") > rules.repeat_percent * F.col("_n_words")),
    })
    limit = lambda most, slack: most + slack / F.sqrt(F.col("_n_words").cast("double"))
    near = F.when(guarded, (F.col("_class_distance") <= limit(rules.most_class_distance, rules.class_slack)) & (F.col("_word_distance") <= limit(rules.most_word_distance, rules.word_slack))).otherwise(True)
    return rows.withColumn("_kept", ~F.col("_base_failed") & near).drop(all_classes, all_commons, all_words, "_classes", "_commons", "_lang")
