"""Corpus-level statistics: vocabulary, similarity, themes, metrics, users, references between projects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import Frames
from ..functions import patterns as P
from ..operators import cosine
from ..result import TechniqueResult, findings_of, technique, union

WORD = r"[a-z]{2,}"
MOST_PROJECTS = 20_000


def terms(docs: DataFrame, pairs: bool = True) -> DataFrame:
    """``doc_id, term``: lower-case ASCII words of two letters or more, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), 0)
    rows = docs.where("text is not null").select("doc_id", F.posexplode(words).alias("i", "term"))
    if not pairs:
        return rows.select("doc_id", "term")
    both = F.concat_ws(" ", "term", F.lead("term").over(W.partitionBy("doc_id").orderBy("i")))
    two = rows.select("doc_id", both.alias("term")).where(F.contains("term", F.lit(" ")))
    return rows.select("doc_id", "term").unionByName(two)


def tf_idf(docs: DataFrame, pairs: bool = False) -> DataFrame:
    """``doc_id, term, weight``: L2-normalised counts times ln((1 + N) / (1 + df)) + 1."""
    counts = terms(docs, pairs).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.where("text is not null").count()
    rows = counts.join(df, "term").select("doc_id", "term", (F.col("n") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    return rows.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))).drop("w")


def top_terms(docs: DataFrame, group: str, k: int = 10, pairs: bool = False) -> DataFrame:
    """The terms of greatest mean weight in each group of documents."""
    weighted = tf_idf(docs, pairs).join(docs.select("doc_id", group), "doc_id")
    sizes = docs.where("text is not null").groupBy(group).agg(F.count("*").alias("size"))
    mean = weighted.groupBy(group, "term").agg(F.sum("weight").alias("s")).join(sizes, group).select(group, "term", (F.col("s") / F.col("size")).alias("score"))
    nth = F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "term"))
    return mean.withColumn("rank", nth).where(F.col("rank") <= k)


def similar_documents(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``a, b, cosine``: pairs of documents whose cosine is above ``least``, each the least of its equal vectors.

    Copies are taken together first (``similarity_links`` says which), so they are
    not multiplied into pairs.  All pairs of blocks of documents are multiplied; no
    table of candidates is shuffled.
    """
    return cosine.compared(cosine.blocks(docs, WORD)[0], least)


def similarity_links(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``doc_id, rep, links``: the class of each document with words and how many other classes it is similar to."""
    whole, classes = cosine.blocks(docs, WORD)
    links = cosine.compared(whole, least, links=True)
    return classes.join(links, "rep", "left").select("doc_id", "rep", F.coalesce("links", F.lit(0)).alias("links"))


def similarity_clusters(pairs: DataFrame) -> DataFrame:
    """Density clusters with a minimum of two points: the components of the pair graph."""
    return components(pairs.select("a", "b"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` of an undirected graph of ``a, b`` by least-label joins with pointer jumping.

    For graphs of projects or documents of one corpus; each round is one join and
    one aggregation, checkpointed where the session has a folder for it.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    spark = edges.sparkSession
    durable = spark.conf.get("spark.checkpoint.dir", None) is not None
    if durable and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    cut = (lambda df: df.checkpoint()) if durable else (lambda df: df.cache())
    both, label = cut(both), cut(label)
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        least = label.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("c"))
        up = least.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        after = cut(least.join(up, "c", "left").select("node", F.coalesce("cc", "c").alias("component")))
        moved = after.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        label = after
        if not moved:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def theme_counts(docs: DataFrame, themes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Occurrences (not overlapping) and documents of the substrings of each theme."""
    low = F.lower("text")
    times = lambda words: sum(((F.length(low) - F.length(F.replace(low, F.lit(w)))) / len(w) for w in words), F.lit(0.0)).cast("bigint")
    rows = docs.where("text is not null").select(F.inline(F.array(*(F.struct(F.lit(t).alias("theme"), times(w).alias("n")) for t, w in themes.items()))))
    return rows.groupBy("theme").agg(F.sum("n").alias("occurrences"), F.count_if(F.col("n") > 0).alias("documents"))


def corpus_stats(docs: DataFrame, group: str) -> DataFrame:
    words = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 0))
    return docs.where("text is not null").groupBy(group).agg(
        F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum(words).alias("words"), F.avg(F.length("text")).alias("mean_chars"),
        F.percentile(F.length("text"), F.lit(0.5)).alias("median_chars"), F.max(F.length("text")).alias("max_chars"),
    )


def comparative_metrics(values: DataFrame) -> DataFrame:
    """Spread of each metric over corpora, from ``corpus, metric, value`` (null is undefined), and how well it replicates."""
    by = values.groupBy("metric").agg(
        F.count("value").alias("defined"), F.count_if(F.col("value").isNull()).alias("undefined"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )
    spread = F.col("max") - F.col("min")
    ratio = F.when(F.col("min") > 0, F.col("max") / F.col("min"))
    kind = F.when(F.col("defined") < 2, "insufficient").when(ratio <= 1.5, "replicated").when(ratio <= 3, "varies").otherwise("divergent")
    return by.select("*", spread.alias("range"), ratio.alias("ratio"), kind.alias("replication"))


def public_metrics(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Allow-listed findings with a status; a value that is neither a number, truth value nor short plain word is redacted."""
    rows = allowed.join(findings.select("technique", "label", "value_json"), ["technique", "label"], "left")
    value = F.col("value_json")
    plain = value.rlike(r'^-?[0-9.eE+-]+$|^(true|false)$|^"[A-Za-z0-9_./|>-]{1,40}"$')
    status = F.when(value.isNull() | (value == "null"), "undefined").when(plain, "defined").otherwise("redacted")
    return rows.select("technique", "label", F.when(status == "defined", value).alias("value_json"), status.alias("status"))


def warnings_of(strata: DataFrame) -> DataFrame:
    """Warnings from ``sessions, autonomous, parse_errors``."""
    rules = (
        (F.col("sessions") < 30, "tiny_n"),
        (F.col("autonomous") == 0, "no_autonomous_sessions"),
        ((F.col("autonomous") > 0) & (F.col("autonomous") < 10), "few_autonomous_sessions"),
        (F.col("parse_errors") > 0, "parse_errors"),
    )
    return strata.withColumn("warnings", F.array_compact(F.array(*(F.when(c, w) for c, w in rules))))


def user_aggregates(sessions: DataFrame, owners: DataFrame, key: str, user: str, amounts: list[str], category: str, k: int = 3) -> DataFrame:
    """Per user: sessions, distinct keys, sums, means, medians and maxima of the amounts, and the most frequent categories."""
    rows = sessions.join(owners, key, "left")
    parts = [x for c in amounts for x in (F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.max(c).alias(f"{c}_max"))]
    by = rows.groupBy(user).agg(F.count("*").alias("n_sessions"), F.count_distinct(category).alias("n_categories"), *parts)
    counts = rows.where(F.col(category).isNotNull()).groupBy(user, category).agg(F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy(user).orderBy(F.desc("n"), category))
    top = counts.withColumn("r", nth).where(F.col("r") <= k).groupBy(user).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", category, "n"))), lambda x: F.concat(x[category], F.lit(":"), x["n"].cast("string"))), ",").alias("top_categories"))
    return by.join(top, user, "left")


# --- references between projects ---


def _alternation(projects: DataFrame) -> tuple[list[str], str]:
    """Known names, longest first, and one alternation of them at word edges."""
    names = [r.project for r in projects.select("project").distinct().limit(MOST_PROJECTS + 1).collect()]
    if len(names) > MOST_PROJECTS:
        raise ValueError(f"more than {MOST_PROJECTS} projects do not fit into one pattern")
    ordered = sorted(names, key=lambda p: (-len(p), p.lower()))
    return ordered, r"(?<!\w)(" + "|".join(re.escape(p) for p in ordered) + r")(?!\w)"


def mentions(messages: DataFrame, projects: DataFrame, keep: tuple[str, ...] = ("src",)) -> DataFrame:
    """``keep, dst``: each mention of another project in a message of ``src, text``, with functions of the JVM only."""
    ordered, place = _alternation(projects)
    if not ordered:
        return messages.where("false").select(*keep, F.lit("").alias("dst"))
    lookup = {p.lower(): p for p in reversed(ordered)}
    known = F.create_map(*(F.lit(x) for pair in lookup.items() for x in pair))
    found = messages.select(*dict.fromkeys((*keep, "src")), F.explode(F.regexp_extract_all("text", F.lit("(?iU)" + place), 1)).alias("m"))
    return found.withColumn("dst", known[F.lower("m")]).where("dst <> src").select(*keep, "dst")


def reference_weights(references: DataFrame) -> DataFrame:
    return references.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def project_references(messages: DataFrame, projects: DataFrame) -> DataFrame:
    """``src, dst, kind``: each mention of another project in a message of ``src, text``, and what its surroundings say.

    Known names are one alternation, so a text is scanned once.  The list of
    projects goes into the plan; it is a driver-side registry, not data.  Where the
    kind is not asked, ``mentions`` does without Python.
    """
    ordered, place = _alternation(projects)
    if not ordered:
        return messages.sparkSession.createDataFrame([], "src string, dst string, kind string")
    lookup = {p.lower(): p for p in reversed(ordered)}
    place = "(?i)" + place
    texts = messages.select("src", "text")

    def scan(batches):
        import pyarrow as pa

        find = re.compile(place).finditer
        kinds = [(k, re.compile(p, re.IGNORECASE).search) for k, p in P.REFERENCE_TYPES]
        for batch in batches:
            out = ([], [], [])
            for src, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for m in find(text or ""):
                    dst = lookup[m[0].lower()]
                    if dst != src:
                        around = text[max(0, m.start() - 100) : m.end() + 100]
                        for column, x in zip(out, (src, dst, next((k for k, s in kinds if s(around)), "other")), strict=True):
                            column.append(x)
            yield pa.record_batch([pa.array(x, pa.string()) for x in out], ["src", "dst", "kind"])

    return texts.mapInArrow(scan, "src string, dst string, kind string")


def reference_edges(references: DataFrame) -> DataFrame:
    """Weight and dominant kind of each directed edge."""
    kinds = references.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
    return kinds.groupBy("src", "dst").agg(F.sum("n").alias("weight"), F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("dominant_type"))


def graph_degrees(edges: DataFrame) -> DataFrame:
    """In and out degrees and weights of every project with an edge."""
    ends = edges.select(F.col("src").alias("project"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("ow"), F.lit(0).alias("iw")).unionByName(
        edges.select(F.col("dst").alias("project"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("ow"), F.col("weight").alias("iw"))
    )
    return ends.groupBy("project").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("ow").alias("out_weight"), F.sum("iw").alias("in_weight"))


def mutual_pairs(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"]).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def adjacency(edges: DataFrame, projects: list[str]) -> DataFrame:
    return edges.groupBy("src").pivot("dst", projects).agg(F.sum("weight")).na.fill(0)


@technique("cross-project-graph", needs=("sessions", "messages"))
def cross_project_graph(frames: Frames) -> TechniqueResult:
    """Directed graph of mentions between projects."""
    named = frames.sessions.select("session_key", F.trim("project").alias("src")).where("src <> ''")
    messages = frames.messages.where("role in ('User', 'Assistant') and text <> ''").join(named, "session_key").select("src", "text")
    projects = named.select(F.col("src").alias("project")).distinct()
    edges = reference_edges(project_references(messages, projects)).persist()
    nodes = graph_degrees(edges)
    groups = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    hide = P.redacted
    clusters = groups.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list(hide(F.col("node")))), ",").alias("members"))
    clusters = clusters.select(F.row_number().over(W.orderBy(F.desc("size"), "component")).alias("cluster_id"), "size", "members")
    found = (
        frames.sessions.agg(F.count("*").alias("total_sessions")), projects.agg(F.count("*").alias("total_projects")),
        edges.agg(F.count("*").alias("total_edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total_references")),
        mutual_pairs(edges).agg(F.count("*").alias("mutual_pair_count")), clusters.agg(F.count("*").alias("cluster_count")),
        nodes.agg(*(F.min_by(hide(F.col("project")), F.struct(-F.col(w), "project")).alias(n) for n, w in (("largest_hub", "out_weight"), ("largest_authority", "in_weight")))),
    )
    tables = {
        "Edges": edges.select(hide(F.col("src")).alias("source"), hide(F.col("dst")).alias("target"), "weight", "dominant_type"),
        "Nodes": nodes.withColumn("project", hide(F.col("project"))),
        "Clusters": clusters,
    }
    return TechniqueResult("cross-project-graph", tables, union(*(findings_of("cross-project-graph", x) for x in found)))


# --- queries ---


def _docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


THEMES = {"the": ("the", "and"), "ing": ("ing",), "de": (" de ", " la ")}
PROJECTS = ("the", "que", "der", "ing", "para")
_TFIDF = """w as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) as term from documents where text is not null),
c as (select doc_id, lang, term, count(*) as n from w group by all), f as (select term, count(*) as df from c group by term), nd as (select count(*) as n from documents where text is not null),
x as (select doc_id, lang, c.term, c.n * (ln((1.0::double + (select n from nd)) / (1 + df)) + 1) as w from c join f using (term)),
v as (select doc_id, lang, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from x)"""


def _refs(spark, d, kinds: bool = False) -> DataFrame:
    docs = _docs(spark, d).where("text is not null").select(F.element_at(F.array(*map(F.lit, PROJECTS)), (F.col("doc_id") % len(PROJECTS) + 1).cast("int")).alias("src"), "text")
    names = spark.createDataFrame([(p,) for p in PROJECTS], "project string")
    return reference_edges(project_references(docs, names)) if kinds else reference_weights(mentions(docs, names))


_NAMES = "['" + "', '".join(PROJECTS) + "']"
_REFS = f"""dd as (select {_NAMES}[doc_id % {len(PROJECTS)} + 1] as src, lower(text) as text from documents where text is not null),
rf as (select src, n as dst, len(regexp_extract_all(regexp_replace(text, '([\\pL\\pN_]+)', ' \\1 ', 'g'), ' ' || n || ' ')) as c from dd, unnest({_NAMES}) t(n) where n <> src),
eg as (select src, dst, sum(c)::bigint as weight from rf group by src, dst having sum(c) > 0)"""

QUERIES = {
    "tfidf_terms": (
        lambda s, d: top_terms(_docs(s, d), "lang", 10).select("lang", "term", "rank", F.round("score", 5).alias("score")),
        f"""with {_TFIDF}, m as (select lang, term, sum(weight) / (select count(*) from documents q where q.lang is not distinct from v.lang and text is not null) as score from v group by lang, term),
        r as (select *, row_number() over (partition by lang order by round(score, 9) desc, term) as rank from m) select lang, term, rank, round(score, 5) as score from r where rank <= 10""",
    ),
    "theme_counts": (
        lambda s, d: theme_counts(_docs(s, d), THEMES),
        "with t as (select lower(text) as l from documents where text is not null), x as ("
        + " union all ".join(f"select '{t}' as theme, ({' + '.join(f'''(length(l) - length(replace(l, '{w}', ''))) // {len(w)}''' for w in ws)}) as n from t" for t, ws in THEMES.items())
        + ") select theme, sum(n)::bigint as occurrences, count(*) filter (where n > 0) as documents from x group by theme",
    ),
    "corpus_stats": (
        lambda s, d: corpus_stats(_docs(s, d), "lang"),
        r"select lang, count(*) as documents, sum(length(text))::bigint as chars, sum(len(regexp_extract_all(text, '\S+')))::bigint as words, round(avg(length(text)), 6) as mean_chars, round(median(length(text)), 6) as median_chars, max(length(text)) as max_chars from documents where text is not null group by lang",
    ),
    "user_aggregates": (
        lambda s, d: user_aggregates(
            s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderstatus"),
            s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("user_id")), "c_custkey", "user_id", ["o_totalprice"], "o_orderstatus",
        ),
        """with r as (select c_nationkey::bigint as user_id, o_totalprice, o_orderstatus from orders left join customer on o_custkey = c_custkey),
        t as (select user_id, o_orderstatus, count(*) as n, row_number() over (partition by user_id order by count(*) desc, o_orderstatus) as k from r group by user_id, o_orderstatus)
        select a.*, b.top_categories from (select user_id, count(*) as n_sessions, count(distinct o_orderstatus) as n_categories, round(sum(o_totalprice), 6) as o_totalprice_sum, round(avg(o_totalprice), 6) as o_totalprice_mean,
        round(median(o_totalprice), 6) as o_totalprice_median, round(max(o_totalprice), 6) as o_totalprice_max from r group by user_id) a
        left join (select user_id, string_agg(o_orderstatus || ':' || n, ',' order by k) as top_categories from t where k <= 3 group by user_id) b using (user_id)""",
    ),
    "strata_rollup": (
        lambda s, d: _docs(s, d).cube("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars")),
        "select lang, source, grouping(lang) * 2 + grouping(source) as level, count(*) as n, sum(n_chars)::bigint as chars from documents group by cube (lang, source)",
    ),
    "project_refs": (
        lambda s, d: _refs(s, d, kinds=True).select("src", "dst", "weight"),
        f"with {_REFS} select src, dst, weight from eg",
    ),
    "graph_degrees": (
        lambda s, d: graph_degrees(_refs(s, d)),
        f"""with {_REFS}, n as (select src as project, 1 as o, 0 as i, weight as ow, 0 as iw from eg union all select dst, 0, 1, 0, weight from eg)
        select project, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree, sum(ow)::bigint as out_weight, sum(iw)::bigint as in_weight from n group by project""",
    ),
    "graph_adjacency": (
        lambda s, d: adjacency(_refs(s, d), list(PROJECTS)),
        f"with {_REFS} select src, " + ", ".join(f"coalesce(sum(weight) filter (where dst = '{p}'), 0)::bigint as {p}" for p in PROJECTS) + " from eg group by src",
    ),
    "mutual_pairs": (
        lambda s, d: mutual_pairs(_refs(s, d)),
        f"with {_REFS} select x.src as a, x.dst as b from eg x join eg y on x.src = y.dst and x.dst = y.src where x.src < x.dst",
    ),
    "components": (
        lambda s, d: components(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("bigint").alias("a"), (-1 - F.col("o_orderkey") % 500).cast("bigint").alias("b"))),
        """with recursive e0 as (select distinct o_custkey::bigint as a, (-1 - o_orderkey % 500)::bigint as b from orders), e as (select a, b from e0 union select b, a from e0),
        r(root, node) as (select distinct b, b from e0 union select r.root, e.b from r join e on e.a = r.node) select node, min(root) as component from r group by node""",
    ),
    "comparative_metrics": (
        lambda s, d: comparative_metrics(_docs(s, d).groupBy(F.col("lang").alias("corpus")).agg(F.avg("n_chars").alias("v")).select("corpus", F.lit("mean_chars").alias("metric"), F.col("v").alias("value"))),
        """with v as (select lang, avg(n_chars) as value from documents group by lang), b as (select 'mean_chars' as metric, count(value) as defined, count(*) - count(value) as undefined, min(value) as mn, max(value) as mx, avg(value) as mean from v)
        select metric, defined, undefined, round(mn, 6) as min, round(mx, 6) as max, round(mean, 6) as mean, round(mx - mn, 6) as range, round(mx / mn, 6) as ratio,
        case when defined < 2 then 'insufficient' when mx / mn <= 1.5 then 'replicated' when mx / mn <= 3 then 'varies' else 'divergent' end as replication from b""",
    ),
}
