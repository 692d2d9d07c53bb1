"""Retrieval over a graph of entities, relations, communities and the chunks or blocks that they come from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine
from ..sources.tables import stage
from . import graph, retrieval, trees

# Kinds of blocks that a question may be limited to.
MODALS = {"image": "Image", "table": "Table", "section": "Section"}


def known_relations(relations: DataFrame, entities: DataFrame, key: str = "key") -> DataFrame:
    """Relations (source, target, ...) whose ends both are entities."""
    keys = entities.select(F.col(key).alias("_k"))
    return relations.join(keys, F.col("source") == F.col("_k"), "left_semi").join(keys, F.col("target") == F.col("_k"), "left_semi")


def entity_chunks(top: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question, chunk, at): chunks of a question's entities (question, key, rank), in the order in which they first appear; unknown chunks go."""
    named = top.join(entities.select("key", F.posexplode("chunks").alias("pos", "chunk")), "key").join(chunks.select("chunk").distinct(), "chunk", "left_semi")
    first = named.groupBy("question", "chunk").agg(F.min(F.struct("rank", "pos")).alias("f"))
    return first.withColumn("at", F.row_number().over(Window.partitionBy("question").orderBy("f", "chunk"))).drop("f")


def relation_hits(top: DataFrame, relations: DataFrame, most: int = 20) -> DataFrame:
    """The strongest relations at either end of a question's entities (question, key), each once. A question's `most` strongest are among the `most` strongest
    of one of its entities, so only these meet questions."""
    order = [F.desc("strength"), F.asc("source"), F.asc("target")]
    keys = top.select("key").distinct()
    ends = [relations.withColumn("key", F.col(end)).join(keys, "key", "left_semi").select(*relations.columns, "key") for end in ("source", "target")]
    best = retrieval.top(ends[0].unionByName(ends[1]).distinct(), ["key"], order, most).drop("rank")
    every = top.select("question", "key").join(best, "key").select(*relations.columns, "question").distinct()
    return retrieval.top(every, ["question"], order, most)


def community_hits(top: DataFrame, members: DataFrame, most: int = 3) -> DataFrame:
    """(question, community, rank): the first communities (community, key, place) that hold any of a question's entities."""
    found = top.select("question", "key").join(members, "key").groupBy("question", "community").agg(F.min("place").alias("place"))
    return retrieval.top(found, ["question"], [F.asc("place")], most).select("question", "community", "rank")


def mentions(questions: DataFrame, entities: DataFrame, question: str, asked: str, name: str) -> DataFrame:
    """(question, key): entities whose name of two characters or more is in the question, whatever the case.

    Every start of the question is joined with the names by their first two characters, so that names meet only where they may stand. A start takes along
    as much of the question as the longest name has.
    """
    low = F.lower(F.coalesce(asked, F.lit("")))
    names = entities.select("key", F.lower(name).alias("n")).where(F.length("n") > 1).withColumn("gram", F.substring("n", 1, 2))
    longest = names.agg(F.max(F.length("n"))).first()[0] or 2
    every = F.when(F.length(low) > 1, F.sequence(F.lit(1), F.length(low) - 1)).otherwise(F.array().cast("array<int>"))
    starts = questions.select(F.col(question).alias("question"), F.explode(F.array_distinct(F.transform(every, lambda k: F.substring(low, k, F.lit(longest))))).alias("rest"))
    found = starts.withColumn("gram", F.substring("rest", 1, 2)).join(names, "gram").where(F.startswith("rest", F.col("n")))
    return found.select("question", "key").distinct()


def routed(questions: DataFrame, found: DataFrame, question: str) -> DataFrame:
    """Adds route: local where an entity is mentioned, else global."""
    named = found.select(F.col("question").alias(question)).distinct().withColumn("_m", F.lit(True))
    return questions.join(named, question, "left").withColumn("route", F.when(F.col("_m"), "local").otherwise("global")).drop("_m")


def modal(blocks: DataFrame, kind: str, wanted: str) -> DataFrame:
    return blocks.where(F.col(kind) == MODALS.get(wanted, ""))


def page_range(blocks: DataFrame, page: str, wanted: str | None) -> DataFrame:
    """Blocks of pages a-b or n; pages that aren't whole numbers are out; a range that isn't one changes nothing."""
    low, _, high = (wanted or "").partition("-")
    try:
        ends = int(low), int(high or low)
    except ValueError:
        return blocks
    return blocks.where(F.col(page).try_cast("int").between(*ends))


def name_filter(entities: DataFrame, name: str, kind: str, part: str = "", wanted: str = "") -> DataFrame:
    """Entities whose name has a part, in any case, and whose kind is the wanted one; empty conditions don't count."""
    rows = entities.where(F.contains(F.lower(name), F.lit(part.lower()))) if part else entities
    return rows.where(F.col(kind) == wanted) if wanted else rows


def origins(entities: DataFrame) -> DataFrame:
    """(node, keys): the entities of each block, from the blocks of each entity (key, nodes)."""
    return entities.select("key", F.explode("nodes").alias("node")).groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def linked(asked: DataFrame, entities: DataFrame, nearest: DataFrame, least: float = 0.6) -> DataFrame:
    """(question, key): asked names (question, name) by equal name in any case, else by the nearest entity (question, name, key, similarity)."""
    exact = asked.join(entities.groupBy(F.lower("name").alias("_n")).agg(F.min("key").alias("key")), F.lower(asked["name"]) == F.col("_n"), "left").drop("_n")
    open_ = exact.where("key IS NULL").drop("key").join(nearest.where(F.col("similarity") >= least), ["question", "name"])
    best = retrieval.top(open_, ["question", "name"], [F.desc("similarity"), F.asc("key")], 1)
    return exact.where("key IS NOT NULL").select("question", "key").unionByName(best.select("question", "key")).distinct()


def sections_of(picked: DataFrame, tree: DataFrame, doc: str, order: str, section: Column) -> DataFrame:
    """(doc, node): the subtrees of the nearest sections that hold the picked blocks (doc, node), without section blocks unless a subtree has nothing else."""
    above = trees.ancestors(tree, doc, order).join(picked.select("doc", "node"), ["doc", "node"])
    marks = tree.where(section).select(F.col(doc).alias("doc"), F.col(order).alias("ancestor"))
    near = above.join(marks, ["doc", "ancestor"]).groupBy("doc", "node").agg(F.min_by("ancestor", "steps").alias("root"))
    own = picked.select("doc", "node").join(marks.withColumnRenamed("ancestor", "node"), ["doc", "node"]).select("doc", "node", F.col("node").alias("root"))
    below = trees.subtree(tree, doc, order, near.unionByName(own).select("doc", "root").distinct())
    kinds = below.join(tree.select(F.col(doc).alias("doc"), F.col(order).alias("node"), section.alias("_s")), ["doc", "node"])
    other = kinds.groupBy("doc", "root").agg(F.bool_or(~F.col("_s")).alias("_other"))
    return kinds.join(other, ["doc", "root"]).where(~(F.col("_s") & F.col("_other"))).select("doc", "node").distinct()


def ranked_sections(asked: DataFrame, titles: DataFrame, most: int | None = 60) -> DataFrame:
    """(question, doc, node, rank) of the sections of a question's document, by the cosine of their titles with the question, at most `most`: those that a model
    may choose from. Of `asked` (question, doc, vector) and `titles` (doc, node, vector); a title without a vector counts as 0, equal ones go by place."""
    pairs = asked.select("question", "doc", F.col("vector").alias("_q")).join(titles.select("doc", "node", "vector"), "doc")
    near = pairs.select("question", "doc", "node", cosine("_q", "vector").alias("_c"))
    return retrieval.top(near, ["question", "doc"], [F.desc("_c"), F.asc("node")], most or 2**31 - 1).drop("_c")


def selected_by_section(asked: DataFrame, titles: DataFrame, tree: DataFrame, doc: str, order: str, section: Column, chosen: DataFrame | None = None, fallback: int = 3) -> DataFrame:
    """(question, doc, node): what is below the sections chosen for a question (question, node), or below the `fallback` nearest where none of those chosen is
    a section of its document. Sections themselves only if nothing else is there. A document without sections gives all its blocks."""
    ranked = stage(ranked_sections(asked, titles, None))  # without vectors from here on
    if chosen is None:
        roots = ranked.where(F.col("rank") <= fallback)
    else:
        marked = ranked.join(chosen.select("question", "node", F.lit(True).alias("_c")).distinct(), ["question", "node"], "left")
        told = marked.withColumn("_told", F.max("_c").over(Window.partitionBy("question", "doc")))
        roots = told.where(F.when(F.col("_told"), F.col("_c")).otherwise(F.col("rank") <= fallback))
    roots = stage(roots.select("question", "doc", F.col("node").alias("root")))
    blocks = tree.select(F.col(doc).alias("doc"), F.col(order).alias("node"), section.alias("_s"))
    below = trees.subtree(tree, doc, order, roots.select("doc", "root").distinct())
    within = roots.join(below, ["doc", "root"]).select("question", "doc", "node").distinct()
    flat = asked.select("question", "doc").distinct().join(titles.select("doc").distinct(), "doc", "left_anti")
    every = within.join(blocks, ["doc", "node"]).unionByName(flat.join(blocks, "doc"))
    other = F.max(~F.col("_s")).over(Window.partitionBy("question", "doc"))
    return every.withColumn("_other", other).where(~(F.col("_s") & F.col("_other"))).select("question", "doc", "node")


def graph_scores(picked: DataFrame, node_keys: DataFrame, relations: DataFrame, seeds: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, score): personalised PageRank of the picked blocks' entities, summed over each block's entities and scaled to 0..1 (0 where all are equal)."""
    own = picked.join(node_keys.select("node", F.explode("keys").alias("key")), "node")
    keys = own.select("key").distinct()
    edges = relations.join(keys.select(F.col("key").alias("src")), "src", "left_semi").join(keys.select(F.col("key").alias("dst")), "dst", "left_semi")
    ranks = graph.pagerank(edges, seeds.join(keys.withColumnRenamed("key", "node"), "node", "left_semi"), rounds=rounds)
    sums = own.join(ranks, own.key == ranks["node"]).groupBy(own["node"]).agg(F.sum("rank").alias("score"))
    every = picked.select("node").distinct().join(sums, "node", "left").na.fill(0.0, ["score"])
    ends = every.agg(F.min("score").alias("low"), F.max("score").alias("high"))  # one row
    scaled = (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))
    return every.join(F.broadcast(ends)).select("node", F.when(F.col("high") - F.col("low") < 1e-12, 0.0).otherwise(scaled).alias("score"))


def best_points(points: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """A question's points of a global answer (question, community, score): the best by score, then the community's name."""
    return retrieval.top(points.where(F.col("score") >= least), ["question"], [F.desc("score"), F.asc(F.col("community").cast("string"))], most)


def resolve(mentions: DataFrame, book: str, order: str, name: str, vector: str, gradient: float = 0.6, k: int = 10, same: float = 0.95) -> DataFrame:
    """(book, order, entity): entity resolution by gradient. In a book's order, a mention joins the nearest entity at cosine `same`; else its candidates,
    the k nearest, are followed while each is above `gradient` of the one before: if all are followed it is a new entity, else it joins the best. The
    vectors of an entity are averaged. Each step looks at the entities so far, so a book is read in order by one task; books are spread.
    """

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        sums, counts, out = np.zeros((16, len(pdf[vector].iat[0]))), [], []
        for v in (np.asarray(x, float) for x in pdf[vector]):
            own = sums[: len(counts)]
            norms = np.linalg.norm(own, axis=1) * np.linalg.norm(v)
            score = np.divide(own @ v, norms, out=np.zeros(len(own)), where=norms > 0)
            near = np.lexsort((np.arange(len(own)), -score))[:k]
            s = score[near]
            followed = next((n for n in range(1, len(s)) if not s[n] > gradient * s[n - 1]), len(s))
            if len(s) and (s[0] >= same or followed < len(s)):
                pick = int(near[0])
            else:
                pick = len(counts)
                counts.append(0)
                if pick == len(sums):
                    sums = np.concatenate((sums, np.zeros_like(sums)))
            sums[pick] += v
            counts[pick] += 1
            out.append(pick)
        return pd.DataFrame({book: pdf[book].to_numpy(), order: pdf[order].to_numpy(), "entity": out})

    kinds = {f.name: f.dataType.simpleString() for f in mentions.schema}
    return mentions.select(book, order, vector).groupBy(book).applyInPandas(read, f"{book} {kinds[book]}, {order} {kinds[order]}, entity int")


def table_entities(tables: DataFrame, id: str, title: str, text: str) -> DataFrame:
    """(id, table, header): the headers that hang below a table's entity: its first row's cells (ten at most) and the first cells of the next fifteen rows,
    each once. The table is named for its title and its first headers."""
    rows = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda r: F.trim(r) != "")
    cells = F.filter(F.transform(F.split(F.get(rows, F.lit(0)), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    head = F.slice(cells, 1, 10)
    first = F.filter(F.transform(F.slice(rows, 2, 15), lambda r: F.trim(F.substring_index(r, "|", 1))), lambda c: c != "")
    label = F.array_join(F.slice(head, 1, 4), " / ")
    name = F.concat(F.col(title), F.lit(": "), F.when(label == "", F.substring(F.get(rows, F.lit(0)), 1, 40)).otherwise(label))
    named = tables.where(F.size(rows) > 0).select(id, name.alias("table"), F.array_distinct(F.concat(head, first)).alias("headers"))
    return named.select(id, "table", F.explode("headers").alias("header"))
