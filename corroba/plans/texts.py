"""Queries over texts: blocks, headings, chunks, titles, excerpts, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroba.functions import text as T
from corroba.operators.chunking import chunk_id, chunks_of, exploded, pack_blocks
from corroba.operators.claims import classify, fold_predicates, segment_line, segments
from corroba.plans.registry import query, spread_table, table

_WS = r"E' \t\r\n\x0b\x0c'"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '')"


def chunk_sql(blocks: str) -> str:
    """Chunk packing in SQL, as a recursion over blocks (id, pos from 1, txt, hint)."""
    return rf"""
    blocks AS ({blocks}),
    fold AS (
      SELECT id, CAST(0 AS BIGINT) AS pos, '' AS cur, CAST(NULL AS VARCHAR) AS hint, CAST([] AS STRUCT(t VARCHAR, h VARCHAR)[]) AS done
      FROM (SELECT DISTINCT id FROM blocks)
      UNION ALL
      SELECT id, pos, CASE WHEN ready THEN '' ELSE cur2 END, CASE WHEN ready THEN NULL ELSE hint2 END,
             CASE WHEN ready AND trim(cur2, {_WS}) <> '' THEN list_append(done1, {{'t': trim(cur2, {_WS}), 'h': hint2}}) ELSE done1 END
      FROM (
        SELECT *, length(cur2) >= 1000 AS ready FROM (
          SELECT id, pos, CASE WHEN full_ AND trim(cur, {_WS}) <> '' THEN list_append(done, {{'t': trim(cur, {_WS}), 'h': hint}}) ELSE done END AS done1,
                 CASE WHEN full_ OR cur = '' THEN txt ELSE cur || chr(10) || chr(10) || txt END AS cur2,
                 coalesce(nullif(new_hint, ''), CASE WHEN full_ THEN NULL ELSE hint END) AS hint2
          FROM (
            SELECT b.id, b.pos, f.cur, f.hint, f.done, b.txt, b.hint AS new_hint,
                   f.cur <> '' AND length(f.cur) + 2 + length(b.txt) > 1200 AND length(f.cur) >= 800 AS full_
            FROM fold AS f JOIN blocks AS b ON b.id = f.id AND b.pos = f.pos + 1
          )
        )
      )
    ),
    flushed AS (
      SELECT f.id, CASE WHEN trim(cur, {_WS}) <> '' THEN list_append(done, {{'t': trim(cur, {_WS}), 'h': hint}}) ELSE done END AS c
      FROM fold AS f JOIN (SELECT id, max(pos) AS last FROM blocks GROUP BY id) AS m ON m.id = f.id AND m.last = f.pos
    ),
    merged AS (
      SELECT id, CASE WHEN len(c) >= 2 AND length(c[-1].t) < 400
        THEN list_append(c[1:len(c) - 2], {{'t': c[-2].t || chr(10) || chr(10) || c[-1].t, 'h': coalesce(c[-1].h, c[-2].h)}}) ELSE c END AS c
      FROM flushed
    ),
    chunks AS (SELECT id, CAST(i - 1 AS BIGINT) AS chunk_index, c[i].t AS text, c[i].h AS section_hint FROM merged, unnest(range(1, len(c) + 1)) AS u(i))
    """


_TURNS = """SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos, text AS txt,
            CASE WHEN role = 'user' THEN left(text, 40) END AS hint FROM conversations WHERE text IS NOT NULL"""


@query(
    f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS block_index, b[i] AS block
    FROM (SELECT doc_id, {_LINES} AS b FROM documents), unnest(range(1, len(b) + 1)) AS u(i)"""
)
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.parts("text", "\n")).alias("at", "block"))
    return found.select("doc_id", F.col("at").cast("long").alias("block_index"), "block")


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN left(text, 60) END IGNORE NULLS) OVER w AS heading,
    CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS island
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def heading_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("role") == "user", F.left("text", F.lit(60)))
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.last(heading, ignorenulls=True).over(so_far).alias("heading"),
        F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(so_far).cast("long").alias("island"),
    )


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.when(F.col("role") == "user", F.left("text", F.lit(40)))
    return chunks_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", hint)


@query(f"WITH RECURSIVE {chunk_sql(_TURNS)} SELECT id AS conv_id, chunk_index, text, section_hint, CAST(length(text) AS BIGINT) AS char_count FROM chunks")
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_chunks(spark, sf_dir).withColumn("char_count", F.length("text").cast("long"))


_DOC_LINES = f"""SELECT doc_id AS id, i AS pos, b[i] AS txt, CAST(NULL AS VARCHAR) AS hint
    FROM (SELECT doc_id, {_LINES} AS b FROM documents), unnest(range(1, len(b) + 1)) AS u(i)"""


@query(f"WITH RECURSIVE {chunk_sql(_DOC_LINES)} SELECT id AS doc_id, chunk_index, CAST(length(text) AS BIGINT) AS char_count, md5(text) AS digest FROM chunks")
def greedy_chunks_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.transform(T.parts("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit(None).cast("string").alias("hint")))
    chunks = exploded(spread_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", pack_blocks(blocks).alias("chunks")), "doc_id")
    return chunks.select("doc_id", "chunk_index", F.length("text").cast("long").alias("char_count"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    f"""WITH RECURSIVE {chunk_sql(_TURNS)} SELECT id AS conv_id, chunk_index, 'meth:conv/' || id || '.md:' || chunk_index || ':' ||
    left(sha1('conv/' || id || '.md|' || chunk_index || '|' || left(text, 120)), 12) AS chunk_id FROM chunks"""
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md"))
    chunks = conversation_chunks(spark, sf_dir)
    return chunks.select("conv_id", "chunk_index", chunk_id(path, F.col("chunk_index"), F.col("text")).alias("chunk_id"))


@query(
    f"""WITH RECURSIVE {chunk_sql(_TURNS)} SELECT conv_id, count(c.id) AS n_chunks
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN chunks AS c ON c.id = conv_id GROUP BY conv_id"""
)
def chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = conversation_chunks(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"))
    every = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return every.join(counted, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_chunks"))


@query(
    f"""SELECT 'document' AS kind, doc_id AS id, coalesce(nullif(trim(substr(h, 3), {_WS}), ''), CASE WHEN h IS NULL THEN f END, 'doc-' || doc_id) AS title
    FROM (SELECT doc_id, list_filter(b, lambda x: starts_with(x, '# '))[1] AS h, b[1] AS f FROM (SELECT doc_id, {_LINES} AS b FROM documents))
    UNION ALL SELECT 'page', page_id, coalesce(nullif(trim(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), {_WS}), ''), 'page-' || page_id) FROM pages"""
)
def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", T.parts("text", "\n").alias("b"))
    found = found.withColumn("h", F.try_element_at(F.filter("b", lambda x: x.startswith("# ")), F.lit(1)))
    heading = F.nullif(T.strip(F.expr("substr(h, 3)")), F.lit(""))
    first = F.when(F.col("h").isNull(), F.try_element_at("b", F.lit(1)))
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    documents = found.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.coalesce(heading, first, stem).alias("title"))
    title = F.nullif(T.strip(F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1)), F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.coalesce(title, F.concat(F.lit("page-"), F.col("page_id").cast("string"))).alias("title")
    )
    return documents.unionByName(pages)


@query(
    f"""SELECT doc_id, CASE WHEN length(t) > 1600 THEN rtrim(left(t, 1600), {_WS}) || chr(10) || '...' ELSE t END AS excerpt,
    CAST(n AS BIGINT) AS line_count FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:24], chr(10)) AS t,
    least(len(string_split(text, chr(10))), 24) AS n FROM documents)"""
)
def text_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.slice(T.lines("text"), 1, 24)
    found = table(spark, sf_dir, "documents").select("doc_id", F.array_join(kept, "\n").alias("t"), F.size(kept).cast("long").alias("line_count"))
    cut = F.concat(F.rtrim(F.left("t", F.lit(1600)), F.lit(T.SPACES)), F.lit("\n..."))
    return found.select("doc_id", F.when(F.length("t") > 1600, cut).otherwise(F.col("t")).alias("excerpt"), "line_count")


_CLEAN = r"trim(regexp_replace(regexp_replace({}, '`([^`]+)`', '\1', 'g'), '[ \t\r\n\x0b\x0c]+', ' ', 'g'), ' -:;')"


def norm_sql(column: str) -> str:
    """Case folding in SQL: the characters that fold to letters, then A-Z."""
    folded = column
    for character, letters in T.FOLDED:
        folded = f"replace({folded}, '{character}', '{letters}')"
    return (
        rf"trim(regexp_replace(regexp_replace(translate({folded}, '{T.UPPER}', '{T.LOWER}'), '[^a-z0-9_\-./: \t\r\n\x0b\x0c]', ' ', 'g'), '[ \t\r\n\x0b\x0c]+', ' ', 'g'))"
    )


_LINE_ROWS = f"""SELECT doc_id, source, i, b[i] AS line, starts_with(b[i], '#') AS heading
    FROM (SELECT doc_id, source, {_LINES} AS b FROM documents), unnest(range(1, len(b) + 1)) AS u(i)"""
_SEGMENTS = rf"""SELECT doc_id, source, ordinal, section, {_CLEAN.format(r"regexp_replace(regexp_replace(line, '^[-*][ \t]+', ''), '^[0-9]+[.)][ \t]+', '')")} AS claim FROM (
      SELECT doc_id, source, line, heading, CAST(count(*) FILTER (NOT heading) OVER w - 1 AS BIGINT) AS ordinal,
        coalesce(last_value(CASE WHEN heading THEN nullif(trim(ltrim(line, '#'), {_WS}), '') END IGNORE NULLS) OVER w, 'Document') AS section
      FROM ({_LINE_ROWS}) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE NOT heading"""


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, ordinal, section, claim: the cleaned lines of the documents, without empty ones."""
    found = segments(spread_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return found.select("doc_id", "source", F.col("ordinal").cast("long").alias("ordinal"), "section", T.clean(segment_line(F.col("line"))).alias("claim")).filter("claim <> ''")


@query(f"SELECT doc_id, ordinal, section, claim, {norm_sql('claim')} AS normalized FROM ({_SEGMENTS}) WHERE claim <> ''")
def claim_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_claims(spark, sf_dir).select("doc_id", "ordinal", "section", "claim", T.norm("claim").alias("normalized"))


_SPLIT = "list_filter(list_transform(regexp_split_to_array({}, '{}'), lambda x: trim(x, ' .;')), lambda x: x <> '')"


def split_sql(column: str) -> str:
    out = f"[{column}]"
    for n, separator in enumerate((r"\s+but\s+", r"\s+and\s+", ",")):
        out = f"flatten(list_transform({out}, lambda p{n}: {_SPLIT.format(f'p{n}', separator).replace('x:', f'x{n}:').replace('(x,', f'(x{n},').replace(' x <>', f' x{n} <>')}))"
    return out


@query(
    f"""SELECT doc_id, ordinal, logic, CAST(i - 1 AS BIGINT) AS part_index, p[i] AS part FROM (SELECT doc_id, ordinal, logic, CASE WHEN len(q) > 0 THEN q ELSE [claim] END AS p FROM (
      SELECT doc_id, ordinal, claim, CASE WHEN contains(low, ' or ') THEN 'or' WHEN contains(low, ' and ') OR contains(low, ' but ') OR contains(low, ',') THEN 'and' ELSE 'single' END AS logic,
             {split_sql('claim')} AS q FROM (SELECT *, translate(claim, '{T.UPPER}', '{T.LOWER}') AS low FROM ({_SEGMENTS})) WHERE claim <> '')), unnest(range(1, len(p) + 1)) AS v(i)"""
)
def claim_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_claims(spark, sf_dir).select(
        "doc_id", "ordinal", T.claim_logic(F.col("claim")).alias("logic"), F.posexplode_outer(T.split_claim(F.col("claim"))).alias("at", "part")
    )
    return found.select("doc_id", "ordinal", "logic", F.col("at").cast("long").alias("part_index"), "part")


@query(
    f"""SELECT source, normalized, min(struct_pack(d := doc_id, o := ordinal)).d AS doc_id, min(struct_pack(d := doc_id, o := ordinal)).o AS ordinal
    FROM (SELECT source, doc_id, ordinal, {norm_sql('claim')} AS normalized FROM ({_SEGMENTS}) WHERE claim <> '') GROUP BY source, normalized"""
)
def claim_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim of each source and normal text: a minimum, which partial aggregation makes cheap."""
    found = document_claims(spark, sf_dir).groupBy("source", T.norm("claim").alias("normalized"))
    return found.agg(F.min(F.struct("doc_id", "ordinal")).alias("first")).select("source", "normalized", "first.doc_id", "first.ordinal")


_ROUTE = "CASE WHEN conv_id % 3 = 0 THEN 'agent' WHEN conv_id % 3 = 1 THEN 'readme' ELSE 'general' END"


@query(None)
def claim_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("n", T.norm("text"))
    route = F.when(F.col("conv_id") % 3 == 0, "agent").when(F.col("conv_id") % 3 == 1, "readme").otherwise("general")
    found = turns.select("conv_id", "turn", route.alias("route"), classify(route, F.col("n")).alias("c"))
    return found.select("conv_id", "turn", "route", "c.claim_type", "c.verifiable", "c.scope")


def _any_sql(column: str, words: tuple[str, ...], pad: str = "") -> str:
    return "(" + " OR ".join(f"contains({column}, '{pad}{w}{pad}')" for w in words) + ")"


def _classify_sql() -> str:
    from corroba.operators.claims import CLASSES

    def case(part: int) -> str:
        routes = ""
        for route, rules in CLASSES.items():
            whens = "".join(f" WHEN {_any_sql('n', words)} THEN '{values[part]}'" for words, *values in rules if words)
            routes += f" WHEN route = '{route}' THEN CASE{whens} ELSE '{rules[-1][part + 1]}' END" if whens else ""
        return f"CASE{routes} END"

    return f"""SELECT conv_id, turn, route, {case(0)} AS claim_type, {case(1)} = 'yes' AS verifiable, {case(2)} AS scope
    FROM (SELECT conv_id, turn, {_ROUTE} AS route, {norm_sql('text')} AS n FROM conversations)"""


query(_classify_sql())(claim_classify)


@query(
    f"""SELECT conv_id, turn, CASE WHEN {_any_sql("' ' || n || ' '", T.NEGATIONS, ' ')} THEN 'negative' ELSE 'positive' END AS polarity,
    CASE {' '.join(f"WHEN {_any_sql('n', w)} THEN '{k}'" for k, w in T.MODALITIES)} ELSE 'descriptive' END AS modality
    FROM (SELECT conv_id, turn, {norm_sql('text')} AS n FROM conversations)"""
)
def polarity_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.norm("text").alias("n"))
    return turns.select("conv_id", "turn", T.polarity(F.col("n")).alias("polarity"), T.modality(F.col("n")).alias("modality"))


@query(
    f"""WITH RECURSIVE t AS (
      SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, {norm_sql('text')} AS n FROM conversations
    ), fold AS (
      SELECT conv_id, CAST(-1 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS pos, '' AS predicate FROM (SELECT DISTINCT conv_id FROM t)
      UNION ALL
      SELECT t.conv_id, t.turn, t.pos, CASE WHEN contains(n, 'config') THEN 'config_field_exists' WHEN contains(n, 'route') THEN 'route_exists'
        WHEN contains(n, '.md') THEN 'generated_page_exists' WHEN f.predicate IN ('config_field_exists', 'route_exists', 'generated_page_exists') AND contains(n, ' the ') THEN f.predicate
        ELSE 'lexical_hint' END
      FROM fold AS f JOIN t ON t.conv_id = f.conv_id AND t.pos = f.pos + 1
    ) SELECT conv_id, turn, predicate FROM fold WHERE pos > 0"""
)
def prior_atom_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.norm("text").alias("n"))
    rules = ((F.lit("config"), "config_field_exists"), (F.lit("route"), "route_exists"), (F.lit(".md"), "generated_page_exists"))
    return fold_predicates(turns, "conv_id", "turn", "n", rules, F.lit(" the "))


_CHARS = "SELECT doc_id, len(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS latin, len(regexp_replace(coalesce(text, ''), '[^À-ÿ]', '', 'g')) AS other FROM documents"


@query(f"SELECT doc_id, CAST(latin AS BIGINT) AS latin, CAST(other AS BIGINT) AS other, latin + other > 0 AND other < greatest(12, latin // 4) AS repair FROM ({_CHARS})")
def language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether letters of the wanted alphabet (here beyond ASCII) are too few against Latin ones."""
    text = F.coalesce("text", F.lit(""))
    found = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.regexp_count(text, F.lit("[A-Za-z]")).cast("long").alias("latin"),
        F.regexp_count(text, F.lit("[À-ÿ]")).cast("long").alias("other"),
    )
    few = F.col("other") < F.greatest(F.lit(12), F.floor(F.col("latin") / 4))
    return found.withColumn("repair", (F.col("latin") + F.col("other") > 0) & few)
