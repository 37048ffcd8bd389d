"""History: load/repair (S6, P7, P3), prompt lines (W2), repeat suppression
(J1 + D2 + W3 + A3) and the upsert of sent articles (U1, K1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.functions import constants as K
from gazette.functions.dates import is_within_days, parse_iso
from gazette.functions.reuse import evaluated
from gazette.functions.identity import dedupe_keys, with_identity
from gazette.functions.text import normalize_whitespace, truncate_text, unique_non_empty
from gazette.operators.dedupe import greedy_dedupe
from gazette.operators.extract import maybe_selected
from gazette.session import cut_lineage
from gazette.sources.json_elements import RANGE_BYTES, read_elements

# Stored-file layout: {"version": 1, "personas": {"<id>": [entry, ...]}}.
ENTRY_DDL = ("title STRING, titulo STRING, chamada STRING, summaryTitle STRING, resumo STRING, "
             "link STRING, normalizedLink STRING, titleKey STRING, titleKeys ARRAY<STRING>, "
             "sourceTitleKey STRING, sourceTitleKeys ARRAY<STRING>, source STRING, "
             "sentAt STRING, docTitle STRING, docLink STRING")

HISTORY_COLS = ["persona_id", "entry_pos", "title", "chamada", "resumo", "link",
                "normalized_link", "title_key", "title_keys", "source_title_key",
                "source_title_keys", "source", "sent_at", "doc_title", "doc_link"]


def read_history_json(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The JSON history file -> raw entries (persona_id, entry_pos, ...), read
    by ranges of bytes. Malformed JSON fails the read, as the reference refuses it."""
    raw = read_elements(spark, path, "personas", range_bytes)
    return raw.select(F.col("key").alias("persona_id"), F.col("pos").alias("entry_pos"),
                      F.from_json("element", ENTRY_DDL, {"mode": "FAILFAST"}).alias("e")).select(
        "persona_id", "entry_pos", "e.*")


def repair_entries(raw: DataFrame, as_of, lookback_days: int = K.LOOKBACK_DAYS) -> DataFrame:
    """P7 + P3: aliases, whitespace, blank -> null, stored keys kept when
    non-null (an empty stored key stays empty), key arrays = stored + computed;
    then entries older than the lookback are dropped (unknown times kept)."""
    title0 = normalize_whitespace(F.coalesce("title", "titulo", F.lit("")))
    chamada0 = normalize_whitespace(F.coalesce("chamada", "summaryTitle", F.lit("")))
    e = raw.select(
        "persona_id", "entry_pos", "normalizedLink", "titleKey", "titleKeys", "sourceTitleKey",
        "sourceTitleKeys", "source", "sentAt", "docTitle", "docLink",
        title0.alias("_t"), chamada0.alias("_c"),
        normalize_whitespace("resumo").alias("_r"),
        F.coalesce("link", F.lit("")).alias("link"))
    e = e.withColumn("_idt", F.when(F.col("_t") != "", F.col("_t")).otherwise(F.col("_c")))
    e = evaluated(with_identity(e, title="_idt", link="link", chamada="_c", prefix="id_"), "sent_at", parse_iso("sentAt"))
    empty = F.array().cast("array<string>")
    out = e.select(
        "persona_id", "entry_pos",
        F.col("_idt").alias("title"),
        F.nullif(F.col("_c"), F.lit("")).alias("chamada"),
        F.nullif(F.col("_r"), F.lit("")).alias("resumo"),
        "link",
        F.coalesce("normalizedLink", "id_normalized_link").alias("normalized_link"),
        F.coalesce("titleKey", "id_title_key").alias("title_key"),
        unique_non_empty(F.concat(F.coalesce("titleKeys", empty), "id_title_keys"))
        .alias("title_keys"),
        F.coalesce("sourceTitleKey", "id_source_title_key").alias("source_title_key"),
        unique_non_empty(F.concat(F.coalesce("sourceTitleKeys", empty), "id_source_title_keys"))
        .alias("source_title_keys"),
        "source", "sent_at",
        F.col("docTitle").alias("doc_title"), F.col("docLink").alias("doc_link"))
    return out.filter(is_within_days("sent_at", as_of, lookback_days))


def entry_match_keys(history: DataFrame) -> DataFrame:
    """(persona_id, kind, key): link keys and host::title keys of each entry,
    kept in separate namespaces (F7: title keys = list + single key)."""
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    titles = F.coalesce(unique_non_empty(F.concat("source_title_keys", F.array("source_title_key"))),
                        F.array().cast("array<string>"))
    # one generator and no union: the rows stay clustered as the history is
    every = F.concat(F.array(key("L", F.col("normalized_link"))), F.transform(titles, lambda k: key("T", k)))
    both = history.select("persona_id", "entry_pos", F.explode(every).alias("_k")).select(
        "persona_id", "entry_pos", "_k.kind", "_k.key")
    return both.filter(F.col("key").isNotNull() & (F.col("key") != ""))


def history_context(history: DataFrame, max_items: int = K.HISTORY_PROMPT_ITEMS,
                    title_chars: int | None = K.HISTORY_TITLE_LIMIT, chamada_chars: int | None = K.HISTORY_CHAMADA_LIMIT,
                    resumo_chars: int | None = K.HISTORY_RESUMO_LIMIT) -> DataFrame:
    """(persona_id, line_no, line) for the newest ``max_items`` entries;
    unknown send times sort last, ties in stored order."""
    w = Window.partitionBy("persona_id").orderBy(F.col("sent_at").desc_nulls_last(),
                                                 F.col("entry_pos"))
    top = history.withColumn("line_no", F.row_number().over(w)).filter(F.col("line_no") <= max_items)
    part = lambda c, label, limit: F.when(
        F.coalesce(F.col(c), F.lit("")) != "",
        F.concat(F.lit(label), truncate_text(F.col(c), limit) if limit else F.col(c)))
    line = F.concat_ws(" | ",
                       part("title", "Titulo original: ", title_chars),
                       part("chamada", "Chamada enviada: ", chamada_chars),
                       part("resumo", "Resumo enviado: ", resumo_chars),
                       part("link", "Link: ", None))
    return (top.select("persona_id", F.col("line_no").cast("bigint").alias("line_no"),
                       line.alias("line")).filter(F.col("line") != ""))


#: Texts at most whose tables are sent to all tasks, and not exchanged, when many rows meet them.
SENT_TEXTS = 1 << 15


def _text_keys(texts: DataFrame, id_col: str) -> DataFrame:
    """(id_col, kind, key) of texts with their identity."""
    link = F.array(F.struct(F.lit("L").alias("kind"), F.col("normalized_link").alias("key")))
    titles = F.transform("source_title_keys", lambda k: F.struct(F.lit("T").alias("kind"), k.alias("key")))
    return (texts.select(id_col, F.explode(F.concat(link, titles)).alias("_k")).select(id_col, "_k.kind", "_k.key")
            .filter(F.col("key") != "").distinct())


def _sent_if(few: bool):
    """Marks a table of texts as the broadcast side of a join, if they are ``few``."""
    return F.broadcast if few else lambda df: df


def _history_keys_among(history: DataFrame, keys: DataFrame, few: bool) -> DataFrame:
    """(persona_id, kind, key) of the entries that hold one of the ``keys`` (kind, key),
    found in the scan of the history: only these are exchanged."""
    wanted, held = keys.select("kind", "key").distinct(), entry_match_keys(history).select("persona_id", "kind", "key")
    found = (held.join(F.broadcast(wanted), ["kind", "key"], "left_semi") if few
             else maybe_selected(held, wanted.select("key").distinct(), "key"))
    return cut_lineage(found.select("persona_id", "kind", "key").distinct())


def _shared(keys: DataFrame, id_col: str, *key_cols: str) -> DataFrame:
    """The ids that share a key with another id."""
    twice = keys.groupBy(*key_cols).agg(F.min(id_col).alias("_a"), F.max(id_col).alias("_b")).filter("_a <> _b")
    return keys.join(twice.select(*key_cols), [*key_cols], "left_semi").select(id_col).distinct()


def suppress_repeats(selection: DataFrame, articles: DataFrame, history: DataFrame,
                     max_per_persona: int = K.MAX_PER_PERSONA) -> DataFrame:
    """J1 + D2 + W3 + A3 per persona.

    selection: (persona_id, rank, ord) in model rank order; articles: (ord,
    title, link, ...). Returns every looked-up selection row with
    ``status`` in {kept, history, duplicate, unexamined} and the final
    ``slot`` (1..max) of kept rows.

    Keys are looked at once an article: which of them any history entry holds, and
    which articles share one. Only selection rows of such articles meet the
    persona's history or each other; the rest moves once, without its keys.
    """
    ident = cut_lineage(with_identity(articles.select("ord", "title", "link")).select(
        "ord", "normalized_link", "source_title_keys"))
    few = ident.count() <= SENT_TEXTS
    sent = _sent_if(few)
    keys = _text_keys(ident, "ord")
    hist_keys = _history_keys_among(history, keys, few)
    met = keys.join(hist_keys.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    clash = _shared(keys, "ord", "key").withColumn("_clash", F.lit(True))
    sel = (selection.join(sent(ident.select("ord")), "ord").join(sent(clash), "ord", "left")
           .select("persona_id", "rank", "ord", "_clash").repartition("persona_id"))
    # Read by the branches below and by the dedupe's own jobs: materialised
    # once in the checkpoint folder (also keeps the later plans small).
    same = Window.partitionBy("persona_id", "ord")
    sel = cut_lineage(sel.withColumn("_doubt", F.coalesce("_clash", F.min("rank").over(same) != F.max("rank").over(same))).drop("_clash"))
    seen = (sel.join(sent(met), "ord").join(hist_keys, ["persona_id", "kind", "key"], "left_semi")
            .select("persona_id", "rank").distinct())
    marks = seen.groupBy("persona_id").agg(F.collect_set("rank").alias("_seen"))
    in_history = F.coalesce(F.array_contains("_seen", F.col("rank")), F.lit(False))
    dropped, doubtful = F.lit(False), not sel.filter("_doubt").isEmpty()
    marks = cut_lineage(marks) if doubtful else marks
    rows = sel.join(marks, "persona_id", "left")
    if doubtful:
        doubt = rows.filter(F.col("_doubt") & ~in_history).join(ident, "ord").withColumn(
            "keys", dedupe_keys("normalized_link", "source_title_keys"))
        deduped = greedy_dedupe(doubt.select("persona_id", "rank", "ord", "keys"), "rank", "keys", group_cols=["persona_id"])
        gone = deduped.filter(~F.col("kept")).groupBy("persona_id").agg(F.collect_set("rank").alias("_gone"))
        rows, dropped = rows.join(gone, "persona_id", "left"), F.coalesce(F.array_contains("_gone", F.col("rank")), F.lit(False))
    rows = rows.select("persona_id", "rank", "ord", in_history.alias("_in"),
                       (~in_history & ~dropped & F.col("persona_id").isNotNull()).alias("_kept"))
    mine, alike = Window.partitionBy("persona_id"), Window.partitionBy("persona_id", "rank")
    rows = rows.withColumn("slot", F.sum(F.col("_kept").cast("int")).over(
        mine.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = rows.withColumns({
        "_cut": F.min(F.when(F.col("_kept") & (F.col("slot") == max_per_persona), F.col("rank"))).over(mine),
        "_first": F.min("slot").over(alike), "_n": F.count(F.lit(1)).over(alike).cast("int")})
    # a (persona_id, rank) that comes n times has n slots, each with each of its rows n times
    slots = F.sequence("_first", F.col("_first") + F.col("_n") - 1)
    none = F.lit(None).cast("int")
    copies = (F.when(F.col("_in") | F.col("persona_id").isNull(), F.array(none))
              .when(F.col("_kept"), F.when(F.col("_n") == 1, F.array("slot")).otherwise(F.flatten(F.array_repeat(slots, F.col("_n")))))
              .otherwise(F.array_repeat(none, F.col("_n"))))
    examined = F.col("_cut").isNull() | (F.col("rank") <= F.col("_cut"))
    status = (F.when(~examined, F.lit("unexamined"))
              .when(F.col("_in"), F.lit("history"))
              .when(F.col("_kept"), F.lit("kept"))
              .otherwise(F.lit("duplicate")))
    return rows.select("persona_id", "rank", "ord", status.alias("status"), examined.alias("_ok"), F.explode(copies).alias("_slot")).select(
        "persona_id", "rank", "ord", "status", F.when(F.col("_ok"), F.col("_slot")).alias("slot"))


def selection_counts(suppressed: DataFrame) -> DataFrame:
    """A3: kept and removed per persona; removed counts only rows examined
    before the cap stopped the scan."""
    return suppressed.groupBy("persona_id").agg(
        F.count_if(F.col("status") == "kept").cast("bigint").alias("kept"),
        F.count_if(F.col("status").isin("history", "duplicate")).cast("bigint").alias("removed"))


def _fold_upserts():
    """Per-persona sequential upsert over only the entries the sent rows can
    match (plus the sent rows): first match in list order is replaced in
    place, otherwise the row is appended after the persona's last position."""
    import pandas as pd

    def fold(hist: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if sent.empty:
            return pd.DataFrame({"persona_id": [], "entry_pos": [], "seq": []})
        persona = sent["persona_id"].iloc[0]
        def names(r):
            keys = [("T", k) for k in (r.keys if r.keys is not None else ())]
            return keys + [("L", r.normalized_link)] * bool(r.normalized_link)

        held: dict[int, list] = {}  # place: its keys now
        at: dict[tuple, set] = {}  # key: places that hold it
        seqs: dict[int, int] = {}

        def put(place: int, keys: list) -> None:
            for k in held.get(place, ()):
                at[k].discard(place)
            held[place] = keys
            for k in keys:
                at.setdefault(k, set()).add(place)

        for r in hist.sort_values("entry_pos").itertuples():
            put(int(r.entry_pos), names(r))
        next_pos = int(sent["max_pos"].iloc[0]) if pd.notna(sent["max_pos"].iloc[0]) else -1
        for r in sent.sort_values("seq").itertuples():
            keys = names(r)
            place = min((min(at[k]) for k in keys if at.get(k)), default=None)
            if place is None:
                place = next_pos = next_pos + 1
            put(place, keys)
            seqs[place] = int(r.seq)
        rows = [(persona, place, seq) for place, seq in seqs.items()]
        return pd.DataFrame(rows, columns=["persona_id", "entry_pos", "seq"])
    return fold


def places(history: DataFrame, s: DataFrame) -> DataFrame:
    """(persona_id, entry_pos, seq): the place each sent row ``s`` (with its
    identity) takes. A history clustered by persona stays where it is."""
    s_keys = (s.select("persona_id", "seq", F.lit("L").alias("kind"),
                       F.col("normalized_link").alias("key"))
              .unionByName(s.select("persona_id", "seq", F.lit("T").alias("kind"),
                                    F.explode("source_title_keys").alias("key")))
              .filter(F.col("key") != ""))
    h_keys = entry_match_keys(history)
    touched = (h_keys.join(s_keys.select("persona_id", "kind", "key").distinct(),
                           ["persona_id", "kind", "key"], "left_semi")
               .select("persona_id", "entry_pos").distinct())
    hist_in = (history.join(touched, ["persona_id", "entry_pos"], "left_semi")
               .select("persona_id", "entry_pos", "normalized_link",
                       unique_non_empty(F.concat("source_title_keys", F.array("source_title_key")))
                       .alias("keys")))
    max_pos = history.groupBy("persona_id").agg(F.max("entry_pos").alias("max_pos"))
    sent_in = (s.join(max_pos, "persona_id", "left")
               .select("persona_id", "seq", "normalized_link",
                       F.col("source_title_keys").alias("keys"), "max_pos"))
    return (hist_in.groupBy("persona_id").cogroup(sent_in.groupBy("persona_id"))
              .applyInPandas(_fold_upserts(), "persona_id string, entry_pos long, seq long"))


def upserts(history: DataFrame, sent: DataFrame, sent_at, doc_title=None, doc_link=None, as_delta: bool = False) -> DataFrame:
    """The entries that sent articles become, each at the place of the
    entry it replaces or after the persona's last one.

    sent: (persona_id, seq, title, chamada, resumo, link, site) in send order.
    Texts are parsed once each, and sent rows name them. Personas with a sent row that
    shares a key with an entry or with another of their sent rows take part in
    the ordered fold (a cogrouped pandas fold per persona); the rows of all others
    get the places after the last one by their number.

    ``as_delta``: each place once, not materialised, with ``replaces``: whether an
    entry has the place already.
    """
    about = ["title", "chamada", "resumo", "link", "site"]
    texts = with_identity(sent.select(*about).distinct(), title=F.coalesce("title", F.lit("")), link="link",
                          chamada=F.coalesce("chamada", F.lit("")))
    texts = cut_lineage(texts.filter((F.col("normalized_link") != "") | (F.size("source_title_keys") > 0))
                        .withColumn("_text", F.monotonically_increasing_id()))
    named = texts.select("_text", *[F.col(c).alias(f"_{c}") for c in about])
    alike = F.lit(True)
    for c in about:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # read by the keys, the fold and the new rows: materialised once
    few = texts.count() <= SENT_TEXTS
    small = _sent_if(few)
    s = cut_lineage(sent.join(small(named), alike).drop(*about, *[f"_{c}" for c in about]))
    keys = _text_keys(texts, "_text")
    hist_keys = _history_keys_among(history, keys, few)
    held = keys.join(hist_keys.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    clash = _shared(keys, "_text", "kind", "key")
    n = F.count(F.lit(1))
    again = s.groupBy("persona_id").agg(((F.size(F.collect_set("_text")) < n) | (F.size(F.collect_set("seq")) < n)).alias("_again"))
    folded = cut_lineage(again.filter("_again").select("persona_id")
                         .union(s.join(small(clash), "_text", "left_semi").select("persona_id"))
                         .union(s.join(small(held), "_text").join(hist_keys, ["persona_id", "kind", "key"], "left_semi").select("persona_id"))
                         .distinct())
    last = history.groupBy("persona_id").agg(F.max("entry_pos").alias("_last"))
    any_folded = not folded.isEmpty()
    plain = (s.join(folded, "persona_id", "left_anti") if any_folded else s).filter("persona_id IS NOT NULL AND seq IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("persona_id").orderBy("seq"))
    placed = plain.join(last, "persona_id", "left").withColumn("entry_pos", F.coalesce("_last", F.lit(-1)) + number).drop("_last")
    placed = placed.withColumn("replaces", F.lit(False))
    if any_folded:
        mine = s.join(folded, "persona_id", "left_semi")
        at = places(history, mine.join(small(texts), "_text").select("persona_id", "seq", "normalized_link", "source_title_keys"))
        if as_delta:
            at = at.join(last, "persona_id", "left").withColumn("replaces", F.col("entry_pos") <= F.coalesce("_last", F.lit(-1))).drop("_last")
        else:
            at = at.withColumn("replaces", F.lit(None).cast("boolean"))
        at = at.join(mine, ["persona_id", "seq"])
        placed = placed.unionByName(at.dropDuplicates(["persona_id", "entry_pos"]) if as_delta else at)
    new_rows = placed.join(small(texts), "_text").select(
        "persona_id", "entry_pos",
        normalize_whitespace(F.coalesce("title", "chamada", F.lit(""))).alias("title"),
        F.nullif(normalize_whitespace(F.coalesce("chamada", F.lit(""))), F.lit("")).alias("chamada"),
        F.nullif(normalize_whitespace(F.coalesce("resumo", F.lit(""))), F.lit("")).alias("resumo"),
        F.coalesce("link", F.lit("")).alias("link"),
        "normalized_link", "title_key", "title_keys", "source_title_key", "source_title_keys",
        F.col("site").alias("source"),
        (F.col("sent_at") if "sent_at" in s.columns else F.lit(sent_at).cast("timestamp_ntz"))
        .alias("sent_at"),
        (F.col("doc_title") if "doc_title" in s.columns else F.lit(doc_title).cast("string"))
        .alias("doc_title"),
        (F.col("doc_link") if "doc_link" in s.columns else F.lit(doc_link).cast("string"))
        .alias("doc_link"), "replaces")
    return new_rows if as_delta else cut_lineage(new_rows.select(*HISTORY_COLS))


def record_sent(history: DataFrame, sent: DataFrame, sent_at, doc_title=None, doc_link=None,
                as_of=None, lookback_days: int = K.LOOKBACK_DAYS) -> DataFrame:
    """The history with sent articles upserted, then retention. Untouched
    entries pass through a plain anti join."""
    new = upserts(history, sent, sent_at, doc_title, doc_link)
    kept_old = history.join(new.select("persona_id", "entry_pos"), ["persona_id", "entry_pos"],
                            "left_anti").select(*HISTORY_COLS)
    out = kept_old.unionByName(new)
    if as_of is not None:
        out = out.filter(is_within_days("sent_at", as_of, lookback_days))
    return out


def save_history(history: DataFrame, base_dir: str) -> str:
    """K1: commit the history as a new version of the store under ``base_dir``;
    returns the store's folder."""
    from gazette.sources.history_store import HistoryStore
    store = HistoryStore(history.sparkSession, f"{base_dir.rstrip('/')}/history")
    store.save(history)
    return store.base


def load_saved_history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest (or a named) version of the store at ``path``."""
    from gazette.sources.history_store import HistoryStore
    return HistoryStore(spark, path).read(version)
