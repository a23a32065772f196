"""Post-shaped views of the test tables, in Spark and in SQL.

Every view keeps all rows and whole texts of its table; variants are derived per row so that
each rule of the operators is met by some rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.labels import LABEL_CHARS, LABELS, QA_DEFINITION, QA_LABEL, label_dim

KANA26 = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
HAN26 = "一二三四五六七八九十百千万上下左右中大小月日年早木林"
LATIN26 = "abcdefghijklmnopqrstuvwxyz"
ALL_LABELS = (*LABEL_CHARS, QA_LABEL)
#: Partitions to deal each table into; by default a table keeps the splits of its files.
SPLITS: int | None = None
NOW = 1704067200 + 30 * 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if SPLITS:
        df = df.repartition(SPLITS)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def label_at(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in ALL_LABELS]), (index + 1).cast("int"))


SQL_LABELS = "[" + ", ".join(f"'{c}'" for c in ALL_LABELS) + "]"


def sql_label_at(index: str) -> str:
    return f"{SQL_LABELS}[({index}) + 1]"


def _japanese(text: Column, pick: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(pick == 0, text)
        .when(pick == 1, F.translate(low, LATIN26, KANA26))
        .when(pick == 2, F.translate(low, "aeiou", KANA26[:5]))
        .when(pick == 3, F.translate(low, "e", "え"))
        .otherwise(F.translate(low, LATIN26, HAN26))
    )


def _sql_japanese(text: str, pick: str) -> str:
    return f"""CASE {pick} WHEN 0 THEN {text} WHEN 1 THEN translate(lower({text}), '{LATIN26}', '{KANA26}')
        WHEN 2 THEN translate(lower({text}), 'aeiou', '{KANA26[:5]}')
        WHEN 3 THEN translate(lower({text}), 'e', 'え')
        ELSE translate(lower({text}), '{LATIN26}', '{HAN26}') END"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts; the source is the author."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.cast("string").alias("event_id"),
        F.col("source").alias("pubkey"),
        (1700000000 + (doc * 7919) % 3888000).alias("created_at"),
        F.col("text").alias("content"),
        F.array(F.concat(F.lit("r"), (doc % 3).cast("string"))).alias("relay"),
        doc.alias("seq"),
        "lang",
        "n_chars",
    )


_POSTS = """SELECT CAST(doc_id AS VARCHAR) AS event_id, source AS pubkey,
  1700000000 + (doc_id * 7919) % 3888000 AS created_at, text AS content,
  'r' || (doc_id % 3) AS relay, doc_id AS seq, lang, n_chars FROM documents"""


def jposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts spelled in kana, kanji or a mix, with links, tags and promo words added to some."""
    base = posts(spark, sf_dir)
    content = F.concat(
        _japanese(F.col("content"), F.col("n_chars") % 5),
        F.expr("repeat(' https://ex.example/p', cast(seq % 4 as int))"),
        F.expr("repeat(' #t', cast(n_chars % 8 as int))"),
        F.when(F.col("n_chars") % 11 == 0, F.lit(" 今すぐ")).otherwise(F.lit("")),
    )
    return base.withColumn("content", content)


_JPOSTS = f"""SELECT * REPLACE ({_sql_japanese('content', '(n_chars % 5)')}
    || repeat(' https://ex.example/p', seq % 4) || repeat(' #t', n_chars % 8)
    || CASE WHEN n_chars % 11 = 0 THEN ' 今すぐ' ELSE '' END AS content) FROM posts"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document seen on one to three relays, plus one blank and one mention-only event."""
    base = posts(spark, sf_dir)
    copies = base.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seq") % 3)).alias("k"))
    seen = copies.select(
        "event_id", "pubkey", (F.col("created_at") + F.col("k")).alias("created_at"), "content",
        F.concat(F.lit("r"), ((F.col("seq") + F.col("k")) % 4).cast("string")).alias("relay"),
        (F.col("seq") + F.col("k") * 1000000000).alias("seq"), "lang",
    )
    empty = base.select(
        F.concat(F.lit("b"), "event_id").alias("event_id"), "pubkey", "created_at",
        F.lit(chr(0x3000) + " ").alias("content"), F.lit("r0").alias("relay"), "seq", "lang",
    )
    mention = base.select(
        F.concat(F.lit("m"), "event_id").alias("event_id"), "pubkey", "created_at",
        F.concat(F.lit("nostr:"), F.md5("content")).alias("content"), F.lit("r1").alias("relay"), "seq", "lang",
    )
    return seen.unionByName(empty).unionByName(mention)


_OBSERVATIONS = """SELECT event_id, pubkey, created_at + k AS created_at, content, 'r' || ((seq + k) % 4) AS relay,
    seq + k * 1000000000 AS seq, lang FROM (SELECT *, unnest(range(0, seq % 3 + 1)) AS k FROM posts)
  UNION ALL SELECT 'b' || event_id, pubkey, created_at, chr(12288) || ' ', 'r0', seq, lang FROM posts
  UNION ALL SELECT 'm' || event_id, pubkey, created_at, 'nostr:' || md5(content), 'r1', seq, lang FROM posts"""

_IDX = "least(46, CAST(floor(value) AS BIGINT) * CAST(floor(value) AS BIGINT) // 300)"


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labeled rows; low label ids are frequent, high ones rare."""
    whole = F.floor("value").cast("long")
    idx = F.least(F.lit(46).cast("long"), F.floor(whole * whole / 300).cast("long"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pubkey"),
        F.floor(F.unix_micros("ts") / 1000000).cast("long").alias("created_at"),
        F.concat_ws(" ", "event_type", "props", F.lit("ねこ")).alias("content"),
        label_at(idx).alias("label"),
        idx.cast("int").alias("label_id"),
        F.least(F.lit(1.0), F.col("value") / 400).alias("confidence"),
        F.col("event_type").alias("rationale"),
        (F.col("event_id") % 17 == 0).alias("is_uncertain"),
        (1 + (F.col("event_id") % 5 == 0).cast("int")).alias("pass"),
        F.concat(F.lit("model-"), "event_type").alias("source"),
        (F.col("event_id") % 11 != 0).alias("ok"),
        F.col("event_id").alias("seq"),
    )


_LABELED = f"""SELECT CAST(event_id AS VARCHAR) AS event_id, 'u' || user_id AS pubkey,
  epoch_us(ts) // 1000000 AS created_at, event_type || ' ' || props || ' ねこ' AS content,
  {sql_label_at(_IDX)} AS label, CAST({_IDX} AS INTEGER) AS label_id,
  least(1.0, value / 400) AS confidence, event_type AS rationale, event_id % 17 = 0 AS is_uncertain,
  1 + CAST(event_id % 5 = 0 AS INTEGER) AS pass, 'model-' || event_type AS source,
  event_id % 11 <> 0 AS ok, event_id AS seq FROM events"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three logged outcomes per labeled event, later ones with another label."""
    rows = labeled(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seq") % 3)))
    idx = (F.col("label_id") + 7 * F.col("k")) % 47
    return rows.withColumns(
        {
            "label": label_at(idx), "label_id": idx.cast("int"),
            "ok": (F.col("seq") + F.col("k")) % 11 != 0, "ord": F.col("seq") * 10 + F.col("k"),
        }
    ).drop("k")


_ATTEMPTS = f"""SELECT * EXCLUDE (k) REPLACE ({sql_label_at('(label_id + 7 * k) % 47')} AS label,
    CAST((label_id + 7 * k) % 47 AS INTEGER) AS label_id, (seq + k) % 11 <> 0 AS ok), seq * 10 + k AS ord
  FROM (SELECT *, unnest(range(0, seq % 3 + 1)) AS k FROM labeled)"""


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored snapshot whose ids overlap with half of the labeled events."""
    return labeled(spark, sf_dir).withColumns(
        {"event_id": (F.col("seq") * 2).cast("string"), "source": F.lit("snapshot")}
    )


_SNAPSHOT = """SELECT * REPLACE (CAST(seq * 2 AS VARCHAR) AS event_id, 'snapshot' AS source) FROM labeled"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled documents as training rows ``content, label_id, seq``."""
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(marks, "doc_id").select(
        F.col("text").alias("content"),
        (F.col("quality") * 2 + F.col("toxic")).alias("label_id"),
        F.col("doc_id").alias("seq"),
    )


_GOLD = """SELECT text AS content, quality * 2 + toxic AS label_id, doc_id AS seq
  FROM documents JOIN labels USING (doc_id)"""


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as short posts; the role picks the script."""
    pick = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(0)
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("event_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("pubkey"),
        (1700000000 + F.col("conv_id") * 50 + F.col("turn")).alias("created_at"),
        _japanese(F.col("text"), pick).alias("content"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        "conv_id", "turn", "role",
    )


_PICK = "(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END)"
_CHATS = f"""SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS event_id, 'c' || conv_id AS pubkey,
  1700000000 + conv_id * 50 + turn AS created_at, {_sql_japanese('text', _PICK)} AS content,
  conv_id * 100 + turn AS seq, conv_id, turn, role FROM conversations"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answer texts built from events, with thirteen kinds of defects among them."""
    rows = labeled(spark, sf_dir)
    conf = F.round("confidence", 4).cast("string")
    text = F.expr(
        """CASE seq % 13
          WHEN 0 THEN concat('{"label": "', label)
          WHEN 1 THEN concat('{"label":"', label, '","label_id":', label_id, ',"confidence":1.5,"rationale":"r","is_uncertain":false}')
          WHEN 2 THEN concat('{"label":"zzz","label_id":', label_id, ',"confidence":0.5,"rationale":"r","is_uncertain":false}')
          WHEN 3 THEN concat('{"label":"', label, '","label_id":', label_id + 1, ',"confidence":0.5,"rationale":"r","is_uncertain":false}')
          WHEN 4 THEN concat('{"label":"', label, '","confidence":0.5,"rationale":"r","is_uncertain":false}')
          WHEN 5 THEN concat('{"label":"', label, '","label_id":"', label_id, '","confidence":"x","rationale":null,"is_uncertain":"no"}')
          WHEN 6 THEN concat('"', label, '"')
          WHEN 7 THEN concat('{"label":" ', label, ' ","label_id":', label_id, ',"confidence":1,"rationale":"r","is_uncertain":true,"extra":[1]}')
          ELSE concat('{"label":"', label, '","label_id":', label_id, ',"confidence":0.25,"rationale":"', rationale, '","is_uncertain":false}') END"""
    )
    return rows.select("event_id", "pubkey", "created_at", "content", "label", "label_id", "seq", text.alias("answer_text"))


_ANSWERS = """SELECT event_id, pubkey, created_at, content, label, label_id, seq, CASE seq % 13
    WHEN 0 THEN '{"label": "' || label
    WHEN 1 THEN '{"label":"' || label || '","label_id":' || label_id || ',"confidence":1.5,"rationale":"r","is_uncertain":false}'
    WHEN 2 THEN '{"label":"zzz","label_id":' || label_id || ',"confidence":0.5,"rationale":"r","is_uncertain":false}'
    WHEN 3 THEN '{"label":"' || label || '","label_id":' || (label_id + 1) || ',"confidence":0.5,"rationale":"r","is_uncertain":false}'
    WHEN 4 THEN '{"label":"' || label || '","confidence":0.5,"rationale":"r","is_uncertain":false}'
    WHEN 5 THEN '{"label":"' || label || '","label_id":"' || label_id || '","confidence":"x","rationale":null,"is_uncertain":"no"}'
    WHEN 6 THEN '"' || label || '"'
    WHEN 7 THEN '{"label":" ' || label || ' ","label_id":' || label_id || ',"confidence":1,"rationale":"r","is_uncertain":true,"extra":[1]}'
    ELSE '{"label":"' || label || '","label_id":' || label_id || ',"confidence":0.25,"rationale":"' || rationale || '","is_uncertain":false}' END
  AS answer_text FROM labeled"""


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated-post answers: each turn's sentences as the posts of one round of one label."""
    rows = chats(spark, sf_dir)
    idx = F.col("conv_id") % 47
    body = F.when(
        F.col("seq") % 19 == 3, F.concat(F.lit('{"other":'), F.to_json(F.array("content")), F.lit("}"))
    ).otherwise(F.concat(F.lit('{"posts":'), F.to_json(F.split("content", "\\.")), F.lit("}")))
    return rows.select(
        "event_id", "conv_id", "turn", "seq", label_at(idx).alias("label"), idx.cast("int").alias("label_id"),
        (F.floor(F.col("conv_id") / 47) * 20 + F.col("turn")).cast("int").alias("round"),
        body.alias("answer_text"),
    )


_GENERATED = f"""SELECT event_id, conv_id, turn, seq, {sql_label_at('conv_id % 47')} AS label,
  CAST(conv_id % 47 AS INTEGER) AS label_id, CAST(conv_id // 47 * 20 + turn AS INTEGER) AS round,
  content, seq % 19 = 3 AS broken FROM chats"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile events of users, several per user, some with empty names or broken JSON."""
    rows = labeled(spark, sf_dir)
    body = F.expr(
        """CASE seq % 4 WHEN 0 THEN concat('{"name":"n', seq, '","display_name":"', rationale, '"}')
          WHEN 1 THEN concat('{"name":"n', seq, '","display_name":""}')
          WHEN 2 THEN '{"about":"-"}' ELSE concat('{"name"', seq) END"""
    )
    return rows.select("pubkey", "created_at", "seq", body.alias("content"))


_PROFILES = """SELECT pubkey, created_at, seq, CASE seq % 4
    WHEN 0 THEN '{"name":"n' || seq || '","display_name":"' || rationale || '"}'
    WHEN 1 THEN '{"name":"n' || seq || '","display_name":""}'
    WHEN 2 THEN '{"about":"-"}' ELSE '{"name"' || seq END AS content FROM labeled"""


def dim(spark: SparkSession) -> DataFrame:
    return label_dim(spark)


_DIM = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}', '{d}', {'true' if c == QA_LABEL else 'false'})"
    for i, (c, d) in enumerate([*LABELS, (QA_LABEL, QA_DEFINITION)])
) + ") AS t(label_id, label, definition, is_qa)"

_VIEWS = {
    "posts": (_POSTS, ()),
    "jposts": (_JPOSTS, ("posts",)),
    "observations": (_OBSERVATIONS, ("posts",)),
    "labeled": (_LABELED, ()),
    "attempts": (_ATTEMPTS, ("labeled",)),
    "snapshot": (_SNAPSHOT, ("labeled",)),
    "gold": (_GOLD, ()),
    "chats": (_CHATS, ()),
    "answers": (_ANSWERS, ("labeled",)),
    "generated": (_GENERATED, ("chats",)),
    "profiles": (_PROFILES, ("labeled",)),
    "dim": (_DIM, ()),
}


def with_views(*names: str, **extra: str) -> str:
    """``WITH`` clause of the named views (and their inputs), then the extra CTEs in order."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        text, needs = _VIEWS[name]
        for need in needs:
            add(need)
        ordered.setdefault(name, text)

    for name in names:
        add(name)
    ordered.update(extra)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ordered.items()) + "\n"

