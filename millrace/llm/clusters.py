"""Similarity clusters of step texts by reciprocal-nearest-neighbour average linkage.

A step prescribes an operation on a named column. Its text is split into the
column, in one canonical spelling, and the phrasing around it. Steps with
different columns have similarity 0, so a cluster is a column with a cluster
of phrasings. Phrasings are weighted nodes (all steps with the same phrasing
are one node) of a sparse graph: two are joined by an edge if they share a
distinguishing skill, title word or word, and the edge's similarity is that of
what their steps carry. Every phrasing is a node, however rare it is. Clusters
cannot leave the components of the pairs that reach the threshold, so edges are
built inside those only. In each round all mutual best pairs merge in parallel;
linkage is the average over all pairs of steps, absent edges counting 0; it
stops when no similarity reaches the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import components
from millrace.session import broadcast_if_small, checkpointed, materialised

THRESHOLD = 0.5

#: Rows of one feature that meet in one task; the rest go to further blocks, and no pair is lost.
BLOCK_ROWS = 2_000

#: Words of at least one in so many steps are known as words of the language.
WORD_SHARE = 2_000

# --- fixed values: words that order or excuse a step, but are no operation ---

LEAD = re.compile(r"^(?:(?:first(?:ly)?|second(?:ly)?|next|then|finally|lastly|last|after(?:wards| that)|now|also|and)\b[ ,:]*)+", re.I)
TRAIL = re.compile(
    r"(?:[ ,;]*\b(?:so that (?:\w+ ){1,3}works?|before going on|and check the row counts?|as the task (?:asks|says|demands)|as (?:asked|requested|needed|required)|if needed|for later use)|\s*\((?:see|as in|cf\.?) [^()]*\))[\s.!]*$",
    re.I,
)
NOTE = re.compile(r"\s*\((?:optional|required|if needed)\)\s*", re.I)
NUMBER = re.compile(r"^\s*(?:\(?\d+[.):]|step \d+[.:)]?)\s*", re.I)
BULLET = re.compile(r"^\s*[-*+•]\s+(?!\*)")
STAR_TITLE = re.compile(r"^\s*(?:\*\*|__|#+\s*)(.{1,80}?)(?:\*\*|__)\s*[:\-–—.]?\s*(.*)$", re.S)
DASH_TITLE = re.compile(r"^\s*([A-Z][^:`'*_]{1,60}?)\s+[-–—]\s+(.*)$", re.S)
COLON_TITLE = re.compile(r"^\s*([A-Z][^:`'*_.]{1,60}?):\s+(.*)$", re.S)
MARKED = re.compile(r"`([^`\n]{1,80})`|\*\*([^*\n]{1,80})\*\*|(?<![\w'])'([^'\n]{2,80})'(?!\w)|\"([^\"\n]{2,80})\"|<(?:code|b|i|em|strong)>([^<]{1,80})</\w+>|“([^”\n]{1,80})”")
TOKEN = re.compile(r"[^\W_]+(?:_[^\W_]+)*")
CAMEL = re.compile(r"^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+$")
HOLE = "§"


def _canonical(name: str) -> str:
    return re.sub(r"[\W_]+", "", name).lower()


def split_title(text: str) -> tuple[str, str]:
    """``(title, body)`` of a step text, without its number and mark-up."""
    text = BULLET.sub("", NUMBER.sub("", " ".join(text.split())))
    for pattern in (STAR_TITLE, DASH_TITLE, COLON_TITLE):
        m = pattern.match(text)
        if m and m.group(2).strip():
            return NOTE.sub(" ", m.group(1)).strip(" :").lower(), NUMBER.sub("", m.group(2))
    return "", text


def trim(body: str) -> str:
    body = NOTE.sub(" ", body).strip()
    body = LEAD.sub("", body).strip()
    while True:
        shorter = TRAIL.sub("", body.rstrip(" .!;,"))
        if shorter == body:
            return body
        body = shorter


def parse(text: str | None, count: dict[str, int], tails: frozenset[str]) -> tuple[str, str, str] | None:
    """``(title, column, phrasing)``; nothing for a null or wordless text.

    The column is the marked name of the body, else an identifier with an
    underscore or inner capitals that is no common word, else the rarest word
    with a following word that ends column names elsewhere.
    """
    if not text or not TOKEN.search(text):
        return None
    title, body = split_title(text)
    body = trim(body)
    span: tuple[int, int] | None = None
    marked = [m for m in MARKED.finditer(body) if TOKEN.search(m.group())]
    found = list(TOKEN.finditer(body))
    rarest = min((count.get(m.group().lower(), 0) for m in found if not m.group().isdigit()), default=0)
    if marked:
        rarity = lambda m: min(count.get(t.lower(), 0) for t in TOKEN.findall(m.group()))
        best = min(marked, key=lambda m: (rarity(m), m.start()))
        # a marked common word is a setting, not the column
        span = best.span() if rarity(best) <= rarest else None
    if span is None:
        shaped = [m for m in found if "_" in m.group() or CAMEL.match(m.group())]
        rare = lambda m: (count.get(m.group().lower(), 0), -len(m.group()), m.start())
        best = min(shaped, key=rare) if shaped else None
        if best is None or count.get(best.group().lower(), 0) > rarest:
            best = min((m for m in found if not m.group().isdigit()), key=rare, default=None)
        if best is None:
            return title, "", body.lower()
        span = best.span()
        if "_" not in best.group() and not CAMEL.match(best.group()):
            after = TOKEN.match(body, span[1] + 1)
            if after and body[span[1]] == " " and after.group().lower() in tails:
                span = (span[0], after.end())
    column = _canonical(body[span[0] : span[1]])
    phrasing = f"{body[: span[0]]}{HOLE}{body[span[1] :]}"
    name = body[span[0] : span[1]].strip("`*'")
    if name in phrasing:  # named again
        phrasing = re.sub(rf"(?<!\w)[`'*]*{re.escape(name)}[`'*]*(?!\w)", HOLE, phrasing)
    return title, column, " ".join(phrasing.lower().replace("*", "").split()).strip(" .!")


def step_records(steps: DataFrame) -> DataFrame:
    """``(step_id, text, skills)``: one row of each step with a text.

    Of rows extracted again the latest counts. Null rows, arrays, texts and
    inner arrays are left out or empty.
    """
    latest = steps.where("example_id is not null").groupBy("example_id").agg(F.max_by(F.struct("steps", "skills"), F.struct("extracted_at", "steps")).alias("r"))
    exploded = latest.select("example_id", F.posexplode("r.steps").alias("position", "text"), F.col("r.skills").alias("all"))
    skills = F.coalesce(F.try_element_at("all", F.col("position") + 1), F.array().cast("array<string>"))
    return exploded.where("text is not null").select(F.concat_ws("-", "example_id", F.col("position").cast("string")).alias("step_id"), "text", skills.alias("skills"))


def _vocabulary(records: DataFrame) -> tuple[dict[str, int], frozenset[str]]:
    """Counts of common words and the endings of column names; both of bounded size.

    A word is kept if it is in one of ``WORD_SHARE`` steps; as steps have some
    tens of words, that are some ten thousand words at any size.
    """
    total = records.count()
    least = max(2, -(-total // WORD_SHARE))
    token = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"), F.lit(0)), lambda x: F.lower(x)))).alias("word")
    counted = records.select(token).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    count = {r["word"]: r["n"] for r in counted.collect()}
    name = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]+_[\p{L}\p{N}]+(?![\p{L}\p{N}_])"), F.lit(0)), lambda x: F.lower(x)))).alias("name")
    parts = records.select(name).distinct().select(F.substring_index("name", "_", -1).alias("word"))
    # an ending stands behind many different beginnings; a function's name has one
    ends = parts.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(3, least))
    return count, frozenset(r["word"] for r in ends.collect())


def parsed_steps(records: DataFrame) -> DataFrame:
    """``(step_id, title, column, phrasing, skills)`` of the steps with words."""
    count, tails = _vocabulary(records)
    shared = records.sparkSession.sparkContext.broadcast((count, tails))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, tails = shared.value
        for batch in batches:
            rows = [(s, *p, k) for s, t, k in zip(batch["step_id"], batch["text"], batch["skills"], strict=True) if (p := parse(t, count, tails))]
            yield pd.DataFrame(rows, columns=["step_id", "title", "column", "phrasing", "skills"])

    return records.mapInPandas(run, "step_id string, title string, column string, phrasing string, skills array<string>")


def _features(parsed: DataFrame) -> DataFrame:
    """``(phrasing, feature, n)``: how many steps of a phrasing carry a skill or a title, and its own words."""
    skill = parsed.select("phrasing", F.explode(F.array_distinct("skills")).alias("v")).where("v is not null").select("phrasing", F.concat(F.lit("s:"), "v").alias("feature"))
    title = parsed.where("title <> ''").select("phrasing", F.concat(F.lit("t:"), "title").alias("feature"))
    word = parsed.select("phrasing", F.explode(F.array_distinct(F.split("phrasing", "[^\\p{L}\\p{N}_]+"))).alias("v")).where("v <> ''").select("phrasing", F.concat(F.lit("w:"), "v").alias("feature"))
    return skill.unionByName(title).unionByName(word).groupBy("phrasing", "feature").agg(F.count("*").alias("n"))


def _vectors(features: DataFrame, counted: DataFrame) -> DataFrame:
    """``(phrasing, kind, feature, x)``: unit vectors, one a kind of feature, weighted by rarity over the phrasings."""
    seen = features.groupBy("feature").agg(F.sum(F.lit(1.0)).alias("df"))
    total = counted.agg(F.count("*").alias("total"))
    weighted = (
        features.join(counted.select("phrasing", F.col("n").alias("steps")), "phrasing")
        .join(seen, "feature").crossJoin(F.broadcast(total))  # one row
        .withColumn("kind", F.substring("feature", 1, 1))
        .withColumn("x", F.col("n") / F.col("steps") * F.log((F.col("total") + 1) / F.col("df")))
    )
    norm = weighted.groupBy("phrasing", "kind").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return weighted.join(norm, ["phrasing", "kind"]).where("norm > 0").select("phrasing", "kind", "feature", (F.col("x") / F.col("norm")).alias("x"))


#: Parts of the cosines of skills, titles and words: if both phrasings have skills, and otherwise.
SKILLED, PLAIN = {"s": 0.75, "t": 0.1, "w": 0.15}, {"s": 0.0, "t": 0.45, "w": 0.55}


def _blend(both: Column) -> Column:
    """Similarity from the cosines of skills, titles and words; skills count if both have some."""
    sum_of = lambda parts: sum(part * F.col(k) for k, part in parts.items() if part)
    return F.when(both, sum_of(SKILLED)).otherwise(sum_of(PLAIN))


def _dots(met: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` from ``(a, b, kind, xa, xb)``: one row a feature that both phrasings have."""
    skilled = vectors.where("kind = 's'").select("phrasing", F.lit(True).alias("has")).distinct()
    dots = met.groupBy("a", "b").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("xa") * F.col("xb"))), F.lit(0.0)).alias(k) for k in "stw"))
    joined = dots.join(skilled.withColumnsRenamed({"phrasing": "a", "has": "has_a"}), "a", "left").join(skilled.withColumnsRenamed({"phrasing": "b", "has": "has_b"}), "b", "left")
    return joined.select("a", "b", _blend(F.coalesce(F.col("has_a") & F.col("has_b"), F.lit(False))).alias("similarity"))


def _meet(rows: DataFrame, on: list[str], left: dict[str, str], right: dict[str, str], name: str = "phrasing") -> DataFrame:
    """``rows`` joined with themselves on ``on``; a hot key is split into blocks, each with all rows of the other side."""
    hot = rows.groupBy(*on).agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK_ROWS)
    hot = broadcast_if_small(hot.select(*on, F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")), "hot-keys")
    kept = rows.join(hot, on, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    l = kept.withColumn("block", F.pmod(F.xxhash64(name), F.col("blocks")).cast("int")).select(*on, "block", *(F.col(c).alias(n) for c, n in left.items()))
    r = kept.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*on, "block", *(F.col(c).alias(n) for c, n in right.items()))
    return l.join(r, [*on, "block"])


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b, similarity)`` of all pairs of phrasings of at least ``threshold``, each once.

    The similarity is one dot product of vectors of at most unit length, with
    skills for two skilled phrasings and without for others. If the features
    of a vector after some place have a norm below the threshold, then no pair
    reaches it with those alone; so two such phrasings share a feature before
    that place in both vectors, rare features coming first. No pair is lost.
    """
    skilled = vectors.where("kind = 's'").select("phrasing", F.lit(True).alias("has")).distinct()
    rarity = vectors.groupBy("feature").agg(F.count("*").alias("df"))
    known = vectors.join(skilled, "phrasing", "left").withColumn("has", F.coalesce("has", F.lit(False))).join(rarity, "feature")
    square = lambda parts: F.create_map(*(F.lit(v) for kv in parts.items() for v in kv))[F.col("kind")] * F.col("x") * F.col("x")
    plain = known.where("kind <> 's'").select(F.lit("plain").alias("mode"), "phrasing", "has", "feature", "df", square(PLAIN).alias("y"))
    modes = plain.unionByName(known.where("has").select(F.lit("skilled").alias("mode"), "phrasing", "has", "feature", "df", square(SKILLED).alias("y")))
    # the features of one phrasing, common ones first: the norm from each one on
    rest = F.sum("y").over(Window.partitionBy("mode", "phrasing").orderBy(F.desc("df"), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0))
    front = checkpointed(modes.withColumn("rest", rest).where(F.col("rest") >= threshold * threshold - 1e-9).select("mode", "feature", "phrasing", "has"))
    met = _meet(front, ["mode", "feature"], {"phrasing": "a", "has": "has_a"}, {"phrasing": "b", "has": "has_b"})
    pairs = met.where("a < b and not (mode = 'plain' and has_a and has_b)").select("a", "b").distinct()
    l = vectors.select(F.col("phrasing").alias("a"), "kind", "feature", F.col("x").alias("xa"))
    r = vectors.select(F.col("phrasing").alias("b"), "feature", F.col("x").alias("xb"))
    return _dots(pairs.join(l, "a").join(r, ["b", "feature"]), vectors).where(F.col("similarity") >= threshold)


def similarity_edges(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b, similarity)`` of the phrasings of one component that share a distinguishing feature, either way round and with themselves.

    Clusters with an average of at least ``threshold`` hold a pair that reaches
    it, so no cluster leaves a component of such pairs.
    """
    parts = components(checkpointed(near_pairs(vectors, threshold)), "a", "b").select(F.col("node").alias("phrasing"), "component")
    placed = checkpointed(vectors.join(parts, "phrasing", "left").withColumn("component", F.coalesce("component", "phrasing")))
    met = _meet(placed, ["component", "feature"], {"phrasing": "a", "kind": "kind", "x": "xa"}, {"phrasing": "b", "x": "xb"})
    return _dots(met, vectors)


def reciprocal_linkage(nodes: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(node, cluster)`` by average linkage, all mutual best pairs merging in each round.

    ``nodes`` has ``(node, weight)``, ``edges`` ``(a, b, similarity)`` once a
    pair; pairs without an edge have similarity 0. The best neighbour is that
    of the highest similarity, ties going to the smaller pair of names, so the
    best pair of all is always mutual and every round merges something. A
    cluster is named by its smallest node. The state is checkpointed after
    each round, so a lost executor costs a round at most.
    """
    state = checkpointed(nodes.select("node", F.col("node").alias("cluster"), F.col("weight").cast("double").alias("weight")))
    w = nodes.select("node", F.col("weight").cast("double").alias("weight"))
    mass = edges.join(w.withColumnsRenamed({"node": "a", "weight": "wa"}), "a").join(w.withColumnsRenamed({"node": "b", "weight": "wb"}), "b")
    mass = checkpointed(mass.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.col("similarity") * F.col("wa") * F.col("wb")).alias("mass")))
    while True:
        size = state.groupBy("cluster").agg(F.sum("weight").alias("size"))
        sized = mass.join(size.withColumnsRenamed({"cluster": "a", "size": "na"}), "a").join(size.withColumnsRenamed({"cluster": "b", "size": "nb"}), "b")
        near = sized.withColumn("similarity", F.col("mass") / (F.col("na") * F.col("nb"))).where(F.col("similarity") >= threshold)
        # the larger similarity, then the smaller pair of names: the same order from either end
        rank = F.struct((-F.col("similarity")).alias("s"), F.col("a").alias("x"), F.col("b").alias("y"))
        ends = near.select(F.col("a").alias("end"), rank.alias("rank")).unionByName(near.select(F.col("b").alias("end"), rank.alias("rank")))
        best = ends.groupBy("end").agg(F.min("rank").alias("rank"))
        mutual = best.groupBy("rank.x", "rank.y").agg(F.count("*").alias("n")).where("n = 2").select(F.col("x").alias("into"), F.col("y").alias("from"))
        mutual = checkpointed(mutual)
        if mutual.isEmpty():
            return state.select("node", "cluster")
        state = checkpointed(state.join(mutual, state["cluster"] == mutual["from"], "left").select("node", F.coalesce("into", "cluster").alias("cluster"), "weight"))
        moved = mass
        for end in ("a", "b"):
            moved = moved.join(mutual.withColumnsRenamed({"from": end, "into": "to"}), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        mass = checkpointed(moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("mass").alias("mass")))


def cluster_steps(steps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(step_id, cluster, phrasing, typicality)`` of every step with words.

    ``cluster`` is the column and the smallest phrasing of the cluster's
    operation; ``typicality`` the mean similarity of the step's phrasing to
    those of its operation, by their numbers of steps. Null ids, empty arrays
    and null or wordless texts have no row; copies of a text are steps of
    their own.
    """
    parsed = materialised(parsed_steps(step_records(steps)), "steps-parsed")
    counted = parsed.groupBy("phrasing").agg(F.count("*").alias("n"))
    counted = checkpointed(counted)
    vectors = checkpointed(_vectors(_features(parsed), counted))
    edges = checkpointed(similarity_edges(vectors, threshold))
    linked = reciprocal_linkage(counted.select(F.col("phrasing").alias("node"), F.col("n").alias("weight")), edges.where("a < b"), threshold)
    known = linked.select(F.col("node").alias("phrasing"), F.col("cluster").alias("operation"))
    other = known.join(counted, "phrasing").select(F.col("phrasing").alias("b"), F.col("operation").alias("ob"), "n")
    pairs = edges.join(known.withColumnsRenamed({"phrasing": "a", "operation": "oa"}), "a").join(other, "b").where("oa = ob")
    mean = F.sum(F.col("similarity") * F.col("n")) / F.sum("n")
    typical = pairs.groupBy(F.col("a").alias("phrasing")).agg(mean.alias("typicality"))
    named = counted.select("phrasing").join(known, "phrasing", "left").join(typical, "phrasing", "left")
    named = named.select("phrasing", F.coalesce("operation", "phrasing").alias("operation"), F.coalesce("typicality", F.lit(0.0)).alias("typicality"))
    placed = parsed.select("step_id", "column", "phrasing").join(named, "phrasing")
    return placed.select("step_id", F.concat_ws(" | ", "column", "operation").alias("cluster"), "phrasing", "typicality")


def cluster_pairs(clustered: DataFrame) -> DataFrame:
    """``(step_id_a, step_id_b)`` of all pairs of one cluster, smaller id first.

    The pairs of a huge cluster are made in blocks of its rows, each with all
    the others.
    """
    steps = clustered.select("cluster", "step_id")
    met = _meet(steps, ["cluster"], {"step_id": "step_id_a"}, {"step_id": "step_id_b"}, "step_id")
    return met.where("step_id_a < step_id_b").select("step_id_a", "step_id_b")


def describe_clusters(clustered: DataFrame, typical: int = 3) -> DataFrame:
    """``(cluster, size, phrasings, typical)``: the size and the most typical members.

    A typical member is the first step of a phrasing, most typical phrasings
    first. Members are counted by phrasing before they come together, so a
    huge cluster is no huge group.
    """
    by = clustered.groupBy("cluster", "phrasing").agg(F.count("*").alias("n"), F.min("step_id").alias("step_id"), F.max("typicality").alias("typicality"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("typicality", 6)).alias("t"), "step_id")))
    return by.groupBy("cluster").agg(
        F.sum("n").alias("size"), F.count("*").alias("phrasings"), F.transform(F.slice(ranked, 1, typical), lambda x: x["step_id"]).alias("typical")
    )
