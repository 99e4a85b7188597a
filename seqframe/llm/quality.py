"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Every rule votes keep (1) or reject (0) on a document, or abstains (null). The
corpus is reduced to counts of vote patterns, which are few however many
documents there are. Expectation-maximisation over the patterns estimates each
rule's accuracy on good and on bad documents, and the posterior probability of
a document being good replaces an all-must-pass filter. DataFrame functions
only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import text_or_empty, written

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
OTHER = r"[\p{L}\p{N}\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_other"]

#: A rule's vote from the measures: 0 reject, 1 keep, null abstain. The text is SQL, the same in Spark and elsewhere.
RULES = {
    "length": "CASE WHEN n_words < 50 THEN 0 WHEN n_words >= 80 THEN 1 END",
    "word_length": "CASE WHEN word_chars < 3 * n_words OR word_chars > 12 * n_words THEN 0 "
                   "WHEN 10 * word_chars >= 35 * n_words AND word_chars <= 9 * n_words THEN 1 END",
    "symbols": "CASE WHEN 20 * n_symbols > n_words THEN 0 WHEN 100 * n_symbols <= n_words THEN 1 END",
    "symbol_share": "CASE WHEN 20 * n_symbols > word_chars THEN 0 WHEN 100 * n_symbols <= word_chars THEN 1 END",
    "letters": "CASE WHEN 10 * n_other > word_chars THEN 0 WHEN 20 * n_other <= word_chars THEN 1 END",
    "dup_lines": "CASE WHEN 2 * n_dup_lines > n_lines THEN 0 WHEN 10 * n_dup_lines <= 3 * n_lines THEN 1 END",
    "repeat_words": "CASE WHEN 5 * n_repeat_words > 2 * n_words THEN 0 WHEN 20 * n_repeat_words <= 3 * n_words THEN 1 END",
    "upper_case": "CASE WHEN 5 * n_upper > word_chars THEN 0 WHEN 10 * n_upper <= word_chars THEN 1 END",
    "marks": "CASE WHEN 10 * n_marks > n_words THEN 0 WHEN 50 * n_marks <= n_words THEN 1 END",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: EM: rounds; the first values of P(keep | good, voted), P(reject | bad, voted) and P(good), and the weight, in documents,
#: with which they smooth the estimates. A rule finds one kind of bad document, so its first share of them is low.
ROUNDS, KEEPS, REJECTS, GOOD, WEIGHT = 15, 0.99, 0.2, 0.7, 10.0


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``__m`` of the counts in ``MEASURES``, over whole texts (null: empty)."""
    text = text_or_empty(text_col)
    rows = docs.withColumn("__t", text).withColumn("__w", F.array_remove(F.split(F.col("__t"), SPACE + "+"), ""))
    t, w, n = F.col("__t"), F.col("__w"), F.size("__w")
    count = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]++", ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("__l", lines)
    rows = rows.withColumn("__g", F.when(n >= 4, _windows(w, n)))
    long = lambda c, name: c.cast("long").alias(name)
    return rows.withColumn("__m", F.struct(
        long(n, "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(count("#*$%&|<>"), "n_symbols"),
        long(F.size("__l") - F.size(F.array_distinct("__l")), "n_dup_lines"),
        long(F.coalesce(_covered(F.col("__g")), F.lit(0)), "n_repeat_words"), long(F.size("__l"), "n_lines"),
        long(count("A-Z"), "n_upper"), long(count("!?"), "n_marks"),
        long(F.length(F.regexp_replace(t, OTHER, "")), "n_other"))).drop("__t", "__w", "__l", "__g")


def _windows(w: Column, n: Column) -> Column:
    """Sorted (three words, start) of every 3-word window; words hold no space, so joining them is one-to-one."""
    first, second, third = (F.slice(w, i, n - 2) for i in (1, 2, 3))
    return F.sort_array(F.transform(F.arrays_zip(first.alias("a"), second.alias("b"), third.alias("c")), lambda x, i: F.struct(
        F.concat_ws(" ", x["a"], x["b"], x["c"]).alias("g"), i.alias("i"))))


def _covered(g: Column) -> Column:
    """Words in windows found twice or more: windows equal to a neighbour in sorted order, then the union of their spans."""
    size = F.size(g)
    twice = F.zip_with(F.slice(g, 1, size - 1), F.slice(g, 2, size - 1),
                       lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.sort_array(F.array_distinct(F.flatten(twice)))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(starts, zero, lambda acc, p: F.struct(
        (p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n")), lambda acc: acc["n"])


def fit_rules(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """P(keep | good, voted) as ``good_<rule>``, P(reject | bad, voted) as ``bad_<rule>`` and P(good) as ``good``.

    One pass counts the vote patterns, 3 to the number of rules at most,
    whatever the number of documents. All EM rounds are one expression over
    the array of patterns. An empty table keeps the first values.
    """
    patterns = votes.groupBy(*names).count().agg(F.collect_list(F.struct(
        F.array(*names).alias("v"), F.col("count").cast("double").alias("n"))).alias("patterns"))
    first = F.struct(F.lit(GOOD).alias("p"), F.array_repeat(F.lit(KEEPS), len(names)).alias("good"),
                     F.array_repeat(F.lit(REJECTS), len(names)).alias("bad"))
    fitted = patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda now, _: _em_round(
        F.col("patterns"), now, len(names))).alias("fit")).select("fit.*").first()
    return {"good": fitted["p"]} | {f"{k}_{x}": v for k in ("good", "bad") for x, v in zip(names, fitted[k])}


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + value(x))


def _em_round(patterns: Column, now: Column, n_rules: int) -> Column:
    """New parameters: posteriors of all patterns, then each rule's smoothed shares."""
    odds = F.zip_with(now["good"], now["bad"], lambda g, b: F.struct(F.log(g / (1 - b)).alias("keep"), F.log((1 - g) / b).alias("reject")))
    vote = lambda v, o: F.when(v == 1, o["keep"]).when(v == 0, o["reject"]).otherwise(F.lit(0.0))
    weighed = F.transform(patterns, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), (x["n"] / (1 + F.exp(
        -(F.log(now["p"] / (1 - now["p"])) + _total(F.zip_with(x["v"], odds, vote), lambda y: y))))).alias("good")))

    def shares(w: Column) -> Column:
        def share(vote: int, weight, first: float) -> Column:
            return F.transform(F.sequence(F.lit(1), F.lit(n_rules)), lambda j: (
                _total(w, lambda x: F.when(F.get(x["v"], j - 1) == vote, weight(x)).otherwise(F.lit(0.0))) + first * WEIGHT) / (
                _total(w, lambda x: F.when(F.get(x["v"], j - 1).isNotNull(), weight(x)).otherwise(F.lit(0.0))) + WEIGHT))

        return F.struct(((_total(w, lambda x: x["good"]) + GOOD * WEIGHT) / (_total(w, lambda x: x["n"]) + WEIGHT)).alias("p"),
                        share(1, lambda x: x["good"], KEEPS).alias("good"),
                        share(0, lambda x: x["n"] - x["good"], REJECTS).alias("bad"))

    return F.get(F.transform(F.array(weighed), shares), F.lit(0))


def posterior(p: dict[str, float], names: list[str]) -> Column:
    """Probability of a good document given its votes, rules taken as independent."""
    odds = F.lit(log(p["good"] / (1 - p["good"])))
    for x in names:
        odds = odds + F.when(F.col(x) == 1, F.lit(log(p[f"good_{x}"] / (1 - p[f"bad_{x}"])))).when(
            F.col(x) == 0, F.lit(log((1 - p[f"good_{x}"]) / p[f"bad_{x}"]))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def judge_quality(docs: DataFrame, threshold: float = 0.5, rules: dict[str, str] = RULES,
                  text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct column ``quality``: the measures, base_failed, posterior and kept.

    Texts are read once: the measured rows, without the text unless
    ``keep_text``, are written to the shared folder, counted and judged there.

    A null or empty text has no words and fails. Rows are judged one by one, so
    repeated rows and null or repeated ids need no care. A column named
    ``quality`` is replaced; other columns stay. An empty table stays empty.
    """
    names = [f"__v_{x}" for x in rules]
    votes = lambda rows: rows.select("*", *[
        F.expr(_prefixed(sql, "__m.")).cast("int").alias(v) for v, sql in zip(names, rules.values())])
    seen = docs.drop("quality").transform(measures, text_col)
    seen = written(seen if keep_text else seen.drop(text_col), "measures")
    p = fit_rules(votes(seen.select("__m")), names)
    rows = votes(seen).withColumn("__p", posterior(p, names)).withColumn("__f", F.expr(_prefixed(BASE_FAILED, "__m.")))
    quality = F.struct("__m.*", F.col("__f").alias("base_failed"), F.col("__p").alias("posterior"),
                       (~F.col("__f") & (F.col("__p") >= threshold)).alias("kept"))
    return rows.withColumn("quality", quality).drop("__m", "__p", "__f", *names)


def _prefixed(sql: str, prefix: str) -> str:
    for x in MEASURES:
        sql = sql.replace(x, prefix + x)
    return sql


def oracle_sql(select: str, docs: str = "documents") -> str:
    """DuckDB text of the same judgement; ``select`` reads from ``judged``, one row per document (unique ids)."""
    names = list(RULES)
    spaces = r"[^\x20\x09-\x0D]"
    ctes = [
        f"txt AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs})",
        f"""base AS (SELECT doc_id, t, regexp_extract_all(t, '{spaces}+') AS w,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{spaces}')] AS l FROM txt)""",
        "pos AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM base)",
        "tri AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS d FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i))",
        "win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, d) AS c FROM tri WHERE d IS NOT NULL)",
        """rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (SELECT unnest([0, 1, 2]) AS k)
  WHERE c >= 2 GROUP BY doc_id)""",
        f"""m AS MATERIALIZED (SELECT base.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  len(l) AS n_lines, length(t) - length(translate(t, '{UPPER}', '')) AS n_upper,
  length(t) - length(translate(t, '!?', '')) AS n_marks, length(regexp_replace(t, '{OTHER}', '', 'g')) AS n_other
  FROM base LEFT JOIN rep ON rep.doc_id = base.doc_id)""",
        "v AS MATERIALIZED (SELECT *, " + ", ".join(f"{sql} AS v_{x}" for x, sql in RULES.items()) + " FROM m)",
        f"pat AS MATERIALIZED (SELECT {', '.join(f'v_{x}' for x in names)}, count(*) AS c FROM v GROUP BY ALL)",
        "p0 AS (SELECT " + f"{GOOD}::DOUBLE AS good, " + ", ".join(f"{v}::DOUBLE AS {k}_{x}" for x in names for k, v in (("good", KEEPS), ("bad", REJECTS))) + ")",
    ]
    odds = "ln(good / (1 - good))" + "".join(
        f" + CASE v_{x} WHEN 1 THEN ln(good_{x} / (1 - bad_{x})) WHEN 0 THEN ln((1 - good_{x}) / bad_{x}) ELSE 0 END" for x in names)
    for r in range(ROUNDS):
        ctes.append(f"e{r} AS (SELECT pat.*, 1 / (1 + exp(-({odds}))) AS q FROM pat, p{r})")
        ctes.append(f"p{r + 1} AS MATERIALIZED (SELECT (sum(c * q) + {GOOD * WEIGHT}) / (sum(c) + {WEIGHT}) AS good, " + ", ".join(
            f"(coalesce(sum(c * q) FILTER (v_{x} = 1), 0) + {KEEPS * WEIGHT}) / (coalesce(sum(c * q) FILTER (v_{x} IS NOT NULL), 0) + {WEIGHT}) AS good_{x}, "
            f"(coalesce(sum(c * (1 - q)) FILTER (v_{x} = 0), 0) + {REJECTS * WEIGHT}) / (coalesce(sum(c * (1 - q)) FILTER (v_{x} IS NOT NULL), 0) + {WEIGHT}) AS bad_{x}"
            for x in names) + f" FROM e{r})")
    ctes.append(f"""judged AS (SELECT v.*, {BASE_FAILED} AS base_failed,
  NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept FROM v, p{ROUNDS})""")
    return "WITH " + ",\n".join(ctes) + "\n" + select
