"""M7 lexical preselection (declared offline stand-in for the model's pick)."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import constants as K
from gazette.functions.text import clean_topics, title_words


def title_tokens(articles: DataFrame) -> DataFrame:
    """(ord, token): distinct words of each title key."""
    return (articles.select("ord", F.explode(title_words("title")).alias("token"))
            .filter(F.col("token") != "").distinct())


def topic_tokens(profiles: DataFrame, column: str, key: str = "profile") -> DataFrame:
    """(key, topic, token): words of each topic of a cleaned topic list."""
    topics = profiles.select(key, F.explode(F.array_distinct(F.col(column))).alias("topic"))
    return (topics.select(key, "topic", F.explode(F.array_distinct(title_words("topic"))).alias("token"))
            .filter(F.col("token") != ""))


def preselection_limit(max_per_persona: int = K.MAX_PER_PERSONA,
                       multiplier: int = K.PRESELECT_MULTIPLIER) -> int:
    """max(cap, cap * multiplier); the min with the article count is
    implied by ranking at most that many articles."""
    return max(max_per_persona, max_per_persona * multiplier)


def _best(limit: int):
    """Of a block of articles and a part of the profiles: for each profile (and run)
    its ``limit`` best candidates in the block. The block is put in order (newest
    first, undated last, then ``ord``); a word's postings are places in that order,
    so a candidate's place and score decide, and no pair is kept beyond the cut."""
    def best(articles: pa.Table, profiles: pa.Table) -> pa.Table:
        n = articles.num_rows
        articles = articles.take(pc.sort_indices(articles, [("published_at", "descending"), ("ord", "ascending")])) if n else articles
        words = articles["words"].combine_chunks()
        coded = words.flatten().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        codes, size = coded.indices.to_numpy(), np.diff(words.offsets.to_numpy())
        place = np.repeat(np.arange(n), size)[np.argsort(codes, kind="stable")]
        cut = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
        postings = {w: place[cut[i]:cut[i + 1]] for i, w in enumerate(coded.dictionary.to_pylist())}
        run = articles["run"].to_numpy()
        runs = np.unique(run)
        rows, scores, whose = [], [], []
        score = np.zeros(n, np.int64)
        for i, (likes, avoids) in enumerate(zip(profiles["likes"].to_pylist(), profiles["avoids"].to_pylist(), strict=True)):
            met = [[postings[w] for w in topic if w in postings] for topic in likes]
            met = [np.unique(np.concatenate(m)) if len(m) > 1 else m[0] for m in met if m]
            for m in met:
                score[m] += 1
            held = np.concatenate(met) if met else np.empty(0, np.int64)
            for w in avoids or ():
                score[postings.get(w, [])] = 0
            found = np.unique(held[score[held] > 0])
            key = (len(met) - score[found]) * n + found
            for r in runs:
                mine = key if len(runs) == 1 else key[run[found] == r]
                mine = np.sort(np.partition(mine, limit - 1)[:limit] if len(mine) > limit else mine)
                rows.append(mine % n)
                scores.append(len(met) - mine // n)
                whose.append(np.full(len(mine), i))
            score[held] = 0
        flat = lambda parts: np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)
        kept = articles.select(["run", "ord", "published_at"]).take(pa.array(flat(rows)))
        return kept.add_column(0, "profile", profiles["profile"].take(pa.array(flat(whose)))).append_column("score", pa.array(flat(scores)))
    return best


#: Blocks of articles that meet every part of the profiles, and the articles that
#: are not cut further where their number is known.
ARTICLE_BLOCKS, BLOCK_ARTICLES = 4, 1 << 14


def lexical_select(articles: DataFrame, personas: DataFrame,
                   limit: int | None = None, run: Column | None = None, n_articles: int | None = None) -> DataFrame:
    """(persona_id, rank, ord, score) - the offline stand-in for the model's
    preselection. It honours the prompt's checkable rules: priority topics,
    the avoid list, newer first, at most ``limit`` per persona.

    An article is a candidate of a persona when its title holds a word of one
    of the priority topics; the score is the number of topics met that way.
    Candidates whose title holds a word of the avoid list are dropped. The
    rest is ranked by score, then newest (undated last), then ``ord``, and
    only then cut to ``limit``. With ``run``, a long over the articles, the rank
    and the cut are those of each run, and the run is a column of the result.

    Personas with the same two topic lists share one profile, so the work is
    done once per distinct profile. Blocks of articles and parts of the profiles
    meet in a grid of tasks, and each gives only what its profiles may keep:
    candidates, which grow with articles times profiles, are never shuffled.
    ``n_articles``, if known, spares a small run blocks: a profile gives its best once a block.
    """
    limit = limit or preselection_limit()
    lists = personas.select(F.col("id").alias("persona_id"),
                            F.array_sort(F.array_distinct(clean_topics("prioridades"))).alias("likes"),
                            F.array_sort(F.array_distinct(clean_topics("evitar"))).alias("avoids"))
    lists = lists.withColumn("profile", F.to_json(F.struct("likes", "avoids")))
    profiles = lists.select("profile", "likes", "avoids").dropDuplicates(["profile"])
    likes = (topic_tokens(profiles, "likes").groupBy("profile", "topic").agg(F.collect_list("token").alias("words"))
             .groupBy("profile").agg(F.collect_list("words").alias("likes")))
    avoids = topic_tokens(profiles, "avoids").groupBy("profile").agg(F.collect_set("token").alias("avoids"))
    asked = likes.join(avoids, "profile", "left")
    wanted = asked.select(F.explode(F.concat(F.flatten("likes"), F.coalesce("avoids", F.array().cast("array<string>")))).alias("token")).distinct()
    words = (title_tokens(articles).join(wanted, "token", "left_semi")
             .groupBy("ord").agg(F.collect_list("token").alias("words")))
    titled = articles.select("ord", "published_at", (F.lit(0) if run is None else run).cast("long").alias("run")).join(words, "ord")
    tasks = int(personas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = ARTICLE_BLOCKS if n_articles is None else min(ARTICLE_BLOCKS, max(1, -(-n_articles // BLOCK_ARTICLES)))
    parts = max(4, isqrt(tasks)) if n_blocks == ARTICLE_BLOCKS else max(4, tasks // n_blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = titled.withColumn("block", F.pmod(F.xxhash64("ord"), F.lit(n_blocks)).cast("int")).withColumn("part", every(parts))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("profile"), F.lit(parts)).cast("int")).withColumn("block", every(n_blocks))
    schema = {f.name: f.dataType.simpleString() for f in titled.schema}
    cand = blocks.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(
        _best(limit), f"profile string, run long, ord {schema['ord']}, published_at {schema['published_at']}, score long")
    w = Window.partitionBy("profile", "run").orderBy(F.col("score").desc(),
                                                     F.col("published_at").desc_nulls_last(),
                                                     F.col("ord"))
    ranked = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return (lists.select("persona_id", "profile").join(ranked, "profile")
            .select("persona_id", F.col("rank").cast("bigint").alias("rank"), "ord",
                    "score", *([] if run is None else ["run"])))
