"""Group G: text search over bodies and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import search as S
from lodestone.plans.tables import t


def _docs(spark, d):
    return t(spark, d, "documents")


def text_search(spark, d):
    return _docs(spark, d).where(S.body_has(F.col("text"), F.lit("LICENSE"))).select("doc_id", "source")


def body_hits(spark, d):
    return S.body_hits(_docs(spark, d), "text", ["doc_id"], "license").select("doc_id", "hit", "line_no", "text")


def context_window(spark, d):
    return S.context_window(_docs(spark, d), "text", ["doc_id"], "license", 1, 2, 3)


def find_skd(spark, d):
    q = t(spark, d, "benchmark").where(S.body_has(F.col("text"), F.lit("than")))
    return q.select("item_id", S.snippet(F.col("text"), "than", 20, 60).alias("snippet"))


def get_method(spark, d):
    return t(spark, d, "conversations").where((F.lower("role") == F.lower(F.lit("USER"))) & (F.col("conv_id") == 5)).select("conv_id", "turn", "text")


def line_col(spark, d):
    at = F.instr(F.lower("text"), "apache") - 1
    line, col = S.line_col(F.col("text"), at)
    return _docs(spark, d).where("instr(lower(text), 'apache') > 0").select("doc_id", line.alias("line"), col.alias("col"))


def index_semijoin(spark, d):
    """Postings of trigrams narrow the rows, the exact test decides."""
    q = t(spark, d, "benchmark")
    return S.index_search(q, S.ngram_postings(q, "item_id", "text"), "item_id", "text", "Onth").select("item_id")


def find_xdto(spark, d):
    """Titles, then links, as one numbered list."""
    p = t(spark, d, "pages")
    titles = p.select(F.lit(1).alias("section"), "page_id", F.lit(0).cast("long").alias("ord"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"))
    links = p.select(F.lit(2).alias("section"), "page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("ord", "name")).withColumn("ord", F.col("ord").cast("long"))
    both = titles.unionByName(links).where(F.contains(F.lower("name"), F.lit("on")))
    return both.orderBy("section", "page_id", "ord").offset(10).limit(150)


def search_lines(spark, d):
    """All lines with their numbers."""
    return S.lines(_docs(spark, d), "text", ["doc_id"]).select("doc_id", "line_no", F.length("line").cast("long").alias("size"))


def whitespace_collapse(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text"))


QUERIES = {f.__name__: f for f in (text_search, body_hits, context_window, find_skd, get_method, line_col, index_semijoin, find_xdto, search_lines, whitespace_collapse)}

_L = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)"
SQL = {
    "text_search": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')",
    "body_hits": f"""WITH {_L}, h AS (SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS hit FROM l WHERE contains(lower(line), 'license'))
        SELECT doc_id, hit, n AS line_no, left(trim(line), 150) AS text FROM h WHERE hit <= 3""",
    "context_window": f"""WITH {_L}, h AS (SELECT doc_id, n AS hit_line FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l WHERE contains(lower(line), 'license')) WHERE k <= 3),
        x AS (SELECT h.doc_id, hit_line, arg_max(l.line, l.n) FILTER (l.n < hit_line AND trim(l.line) <> '') AS previous, arg_min(l.line, l.n) FILTER (l.n > hit_line AND trim(l.line) <> '') AS following FROM h JOIN l ON l.doc_id = h.doc_id GROUP BY 1, 2)
        SELECT x.doc_id, hit_line, previous, following, l.n AS line_no, l.line FROM x JOIN l ON l.doc_id = x.doc_id AND l.n BETWEEN hit_line - 1 AND hit_line + 2""",
    "find_skd": """WITH q AS (SELECT item_id, text, instr(lower(text), 'than') AS pos FROM benchmark WHERE contains(lower(text), 'than'))
        SELECT item_id, regexp_replace(substr(text, greatest(pos - 20, 1), pos + 60 - greatest(pos - 20, 1)), '[\r\n]+', ' ', 'g') AS snippet FROM q""",
    "get_method": "SELECT conv_id, turn, text FROM conversations WHERE lower(role) = 'user' AND conv_id = 5",
    "line_col": """WITH p AS (SELECT doc_id, left(text, instr(lower(text), 'apache') - 1) AS x FROM documents WHERE instr(lower(text), 'apache') > 0)
        SELECT doc_id, len(string_split(x, chr(10))) - 1 AS line, length(string_split(x, chr(10))[-1]) AS col FROM p""",
    "index_semijoin": "SELECT item_id FROM benchmark WHERE contains(lower(text), 'onth')",
    "find_xdto": """WITH a AS (SELECT 1 AS section, page_id, 0::BIGINT AS ord, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name FROM pages
          UNION ALL SELECT 2, page_id, unnest(range(len(x))), unnest(x) FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM pages))
        SELECT section, page_id, ord, name FROM a WHERE contains(lower(name), 'on') ORDER BY section, page_id, ord LIMIT 150 OFFSET 10""",
    "search_lines": f"WITH {_L} SELECT doc_id, n AS line_no, length(line) AS size FROM l",
    "whitespace_collapse": r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations",
}
