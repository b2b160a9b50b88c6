"""Operators on a corpus of steps, skills and evaluated cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.stem import stem_column
from millrace.operators.graph import components
from millrace.operators.joins import overlap_pairs

# Words that carry no meaning in a name.
NAME_STOPWORDS = ("and", "or", "the", "a", "an", "of", "for", "in", "on", "with", "to")

# Families of algorithms and the words that name them.
ALGORITHM_FAMILIES = (
    ("trees", r"(?i)\b(?:random\s*forest|decision\s*tree|gradient\s*boost(?:ing)?|xgboost|lgbm|lightgbm|catboost)\b"),
    ("linear models", r"(?i)\b(?:linear\s*regression|logistic\s*regression|ridge|lasso|elastic\s*net)\b"),
    ("support vectors", r"(?i)\b(?:svm|svr|svc|support\s*vector)\b"),
    ("clustering", r"(?i)\b(?:k[\s-]?means|dbscan|hierarchical\s*cluster|agglomerative)\b"),
    ("reduction", r"(?i)\b(?:pca|t[\s-]?sne|umap|dimensionality\s*reduction|singular\s*value\s*decomp)\b"),
    ("forecasting", r"(?i)\b(?:arima|sarima|prophet|exponential\s*smoothing|time\s*series\s*(?:forecast|decompos))\b"),
    ("neural networks", r"(?i)\b(?:neural\s*network|mlp|(?:deep\s*learn)|cnn|rnn|lstm|gru|transformer|bert|gpt)\b"),
    ("text", r"(?i)\b(?:tf[\s-]?idf|word2vec|fasttext|word\s*embedding|sentiment\s*analy)\b"),
    ("tests", r"(?i)\b(?:hypothesis\s*test|chi[\s-]?square|t[\s-]?test|anova|mann[\s-]?whitney|kolmogorov|shapiro|kruskal)\b"),
    ("resampling", r"(?i)\b(?:cross[\s-]?valid|k[\s-]?fold|bootstrap|bagging|boosting|stacking|ensemble)\b"),
    ("stochastic models", r"(?i)\b(?:markov|bayesian|monte\s*carlo|expectation[\s-]?maximization)\b"),
    ("interpolation", r"(?i)\b(?:interpolat|extrapolat|spline|kernel\s*density|kde)\b"),
    ("tabular models", r"(?i)\b(?:dax|power\s*bi|olap|mdx|tabular\s*model)\b"),
    ("signals", r"(?i)\b(?:fourier|wavelet|signal\s*process|spectral\s*analy)\b"),
    ("anomalies", r"(?i)\b(?:anomaly\s*detect|outlier\s*detect|isolation\s*forest|one[\s-]?class\s*svm)\b"),
    ("associations", r"(?i)\b(?:association\s*rule|apriori|fp[\s-]?growth|market\s*basket)\b"),
    ("networks", r"(?i)\b(?:network\s*analy|graph\s*algorithm|pagerank|centrality|community\s*detect)\b"),
    ("survival", r"(?i)\b(?:survival\s*analy|kaplan[\s-]?meier|cox\s*regression|hazard)\b"),
    ("search", r"(?i)\b(?:genetic\s*algorithm|evolutionary|simulated\s*anneal|particle\s*swarm)\b"),
    ("cluster quality", r"(?i)\b(?:silhouette|elbow\s*method|davies[\s-]?bouldin|calinski)\b"),
    ("causality", r"(?i)\b(?:granger\s*causality|cointegrat|augmented\s*dickey|stationarity)\b"),
    ("hidden states", r"(?i)\b(?:hidden\s*markov|viterbi|em\s*algorithm)\b"),
    ("recommenders", r"(?i)\b(?:collaborative\s*filter|matrix\s*factoriz|recommender|content[\s-]?based\s*filter)\b"),
    ("kernels", r"(?i)\b(?:naive\s*bayes|gaussian\s*process|kernel\s*regression)\b"),
)


def step_skills(steps: DataFrame) -> DataFrame:
    """``(example_id, position, skill)`` of steps and their aligned skills; nulls have no row. Repeated rows count once."""
    rows = steps.where("example_id is not null and skills is not null").select("example_id", "skills").distinct()
    return rows.select("example_id", F.posexplode("skills").alias("position", "s")).select("example_id", "position", F.explode("s").alias("skill")).where("skill is not null").distinct()


def consecutive_pairs(skills: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: pairs of different skills at a step and the next step that has any."""
    rank = F.dense_rank().over(W.partitionBy("example_id").orderBy("position"))
    ranked = skills.withColumn("rk", rank).select("example_id", "rk", "skill")
    after = ranked.select("example_id", (F.col("rk") - 1).alias("rk"), F.col("skill").alias("dst"))
    pairs = ranked.withColumnRenamed("skill", "src").join(after, ["example_id", "rk"]).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def early_skills(skills: DataFrame, share: float = 0.1) -> DataFrame:
    """Skills found in the first steps of an example: those before ``floor(n * share)``, at least the first."""
    last = skills.groupBy("example_id").agg((F.max("position") + 1).alias("n"))
    early = F.col("position") < F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return skills.join(last, "example_id").where(early).select("skill").distinct()


def source_counts(clusters: DataFrame, members: str = "cluster") -> DataFrame:
    """``(graph_id, members, sources)``: distinct members and distinct examples of each cluster; ids are ``a-b-position``."""
    m = clusters.select("graph_id", F.explode(F.array_distinct(members)).alias("m")).where("m is not null")
    return m.groupBy("graph_id").agg(F.count("*").alias("members"), F.count_distinct(F.substring_index("m", "-", 2)).alias("sources"))


def merged_by_name(clusters: DataFrame, name: str = "name", members: str = "cluster") -> DataFrame:
    """``(name, members)``: clusters of equal lower-case name as one, without repeated members. Null names stay apart."""
    named = clusters.where(F.col(name).isNotNull()).select(F.lower(F.trim(name)).alias("name"), F.explode(members).alias("m")).where("m is not null").distinct()
    return named.groupBy("name").agg(F.array_sort(F.collect_list("m")).alias("members"))


def shortest_name(names: DataFrame, by: str, name: str) -> DataFrame:
    """``(by, representative)``: the name with the fewest words, then characters, then the first."""
    words = F.size(F.filter(F.split(F.col(name), r"[\s\-_/&]+"), lambda x: x != ""))
    return names.where(F.col(name).isNotNull()).groupBy(by).agg(F.min(F.struct(words.alias("w"), F.length(name).alias("l"), F.col(name).alias("v"))).alias("b")).select(by, F.col("b.v").alias("representative"))


def stemmed_words(names: DataFrame, name: str) -> DataFrame:
    """``(name, words)``: the distinct stems of each distinct name. Each distinct word is stemmed once."""
    base = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    long = base.select("name", F.explode(F.array_distinct(F.transform(F.split(F.lower(F.trim("name")), r"[\s\-_/&]+"), lambda x: F.regexp_replace(x, "[^a-z0-9']", "")))).alias("word")).where("word <> ''")
    stems = long.select("word").distinct().withColumn("stem", stem_column("word"))
    return long.join(stems, "word").groupBy("name").agg(F.collect_set("stem").alias("words"))


def name_covers(names: DataFrame, name: str, least: float) -> DataFrame:
    """``(name, canonical)``: each name with the shortest name of its group.

    Two names are of one group if they share at least ``least`` of the stems of
    the shorter one. Names without words are their own. The shortest name has
    the fewest stems, then characters, then comes first.
    """
    words = stemmed_words(names, name)
    pairs = overlap_pairs(words, "name", "words", least)
    grouped = components(pairs, "a", "b").select(F.col("node").alias("name"), "component")
    every = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    joined = every.join(grouped, "name", "left").join(words, "name", "left").withColumn("component", F.coalesce("component", "name"))
    best = joined.groupBy("component").agg(F.min(F.struct(F.coalesce(F.size("words"), F.lit(0)).alias("w"), F.length("name").alias("l"), F.col("name").alias("v"))).alias("b"))
    return joined.join(best, "component").select("name", F.col("b.v").alias("canonical"))


def matching_rules(rows: DataFrame, rules: Sequence[tuple[str, str, str | None]], *texts: str) -> Column:
    """Names of the rules a row falls under: a pattern found in any of the texts, and no exempting pattern.

    The rules are a short fixed list, so they become one expression and no join.
    """
    joined = F.concat_ws(" ", *texts)
    hits = [F.when(joined.rlike(pattern) & (F.lit(True) if exempt is None else ~joined.rlike(exempt)), F.lit(name)) for name, pattern, exempt in rules]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def repeats_name(name: Column, description: Column, least: float = 0.85) -> Column:
    """Whether a description says little more than the name: most of its words are the name's."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.isin(*NAME_STOPWORDS)))
    d, n = split(description), split(name)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(d, n)), F.size(d)) >= least, F.lit(False))


def least_used(skills: DataFrame, usage: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A pick of ``n`` skills, least used first, ties in a seeded order."""
    tie = F.xxhash64("skill", F.lit(seed))
    return skills.join(usage, "skill", "left").select("skill", F.coalesce("uses", F.lit(0)).alias("uses")).orderBy("uses", tie, "skill").limit(n)


def shifted_dependencies(steps: DataFrame, inserted: int) -> Column:
    """Dependencies of a step list after a step was inserted before number ``inserted``: larger ones move on, own and later ones go."""
    number = F.col("step") + F.when(F.col("step") >= inserted, 1).otherwise(0)
    moved = F.transform("deps", lambda d: d + F.when(d >= inserted, 1).otherwise(0))
    kept = F.array_sort(F.array_distinct(F.filter(moved, lambda d: d < number)))
    return F.when((F.size(kept) == 0) & (number > 1), F.array(number - 1)).otherwise(kept)


# Classes of an observation and the signs of them, in order.
OBSERVATIONS = (
    ("execution succeeded", r"executed successfully\. No output\."),
    ("action parse failed", r"^Failed to parse action from your response,"),
    ("error message", r"^ERROR:|Traceback \(|^bash: -c: line |Error: "),
    ("warning message", r"Warning:"),
)


def observation_class(text: Column) -> Column:
    """The class of an observation in an agent's log; anything else is standard output."""
    out = F.lit("standard output")
    for name, sign in reversed(OBSERVATIONS):
        out = F.when(text.rlike(sign), name).otherwise(out)
    return F.when(text.isNull(), None).otherwise(out)


def action(text: Column) -> Column:
    """``(name, argument)`` of an action line such as ``fillna(column='x')``; nulls if it is none."""
    name = F.regexp_extract(text, r"^\s*(?:Action:\s*)?([A-Za-z_]\w*)\((.*)\)\s*$", 1)
    argument = F.regexp_extract(text, r"^\s*(?:Action:\s*)?([A-Za-z_]\w*)\((.*)\)\s*$", 2)
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.when(name != "", argument).alias("argument"))


def worst_first(errors: DataFrame, by: str, score: str, text: str, limit: int = 50, characters: int = 5000) -> DataFrame:
    """A report ``(by, report)``: messages of the lowest scores first, at most so many and so long."""
    # only the first rows of a group are collected
    ranked = errors.withColumn("__k", F.row_number().over(W.partitionBy(by).orderBy(score, text))).where(F.col("__k") <= limit)
    first = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__k", F.col(text).alias("__t")))).alias("all"))
    joined = F.array_join(F.transform("all", lambda e: e["__t"]), "\n")
    return first.select(by, F.left(joined, F.lit(characters)).alias("report"))


def mean_scores(results: DataFrame, by: str, score: str = "score", finished: str = "finished") -> DataFrame:
    """``(by, tasks, score, finished)`` with a grand total under ``all``; unfinished tasks score 0."""
    value = F.when(F.col(finished), F.coalesce(score, F.lit(0.0))).otherwise(0.0)
    rolled = results.rollup(by).agg(F.count("*").alias("tasks"), F.avg(value).alias("score"), F.avg(F.col(finished).cast("double")).alias("finished"), F.grouping(by).alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col(by)).alias(by), "tasks", "score", "finished")


def evaluate(cases: Sequence[Mapping], comparators: Mapping[str, object]) -> list[dict]:
    """Scores of declared comparisons ``{id, fn, args}``; functions are looked up by name and texts are never run.

    An unknown function or a failing comparison scores 0 and tells why.
    """
    out = []
    for case in cases:
        try:
            score = float(comparators[case["fn"]](**case.get("args", {})))
            out.append({"id": case["id"], "score": score, "error": None})
        except Exception as problem:  # any failure of a comparison is a result
            out.append({"id": case["id"], "score": 0.0, "error": f"{type(problem).__name__}: {problem}"[:200]})
    return out
