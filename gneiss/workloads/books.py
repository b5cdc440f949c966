"""Files, price books and budget documents: written from the driver's tables, read back by their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import files as names
from gneiss.operators import ordered
from gneiss.plans import layout, pricebooks
from gneiss.sources import files
from gneiss.sources.scratch import scratch_path, stored
from gneiss.workloads.base import query

#: Document k of part p: its lines in order of keys, numbered from 0, n in all.
LINES = """l AS (SELECT l_partkey AS doc_id, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_partkey) AS n, l_quantity FROM lineitem),
b AS (SELECT doc_id, l_orderkey, l_linenumber, CAST(k AS INT) AS k, CAST(n AS INT) AS n, round(l_quantity + (k % 7) * 0.05, 2) AS q, CAST(doc_id % 4 AS INT) AS kind, CAST(k // 4 AS INT) % 3 + 1 AS c FROM l)"""
CHAPTERS = ("TRABAJOS PREVIOS", "ALBAÑILERIA", "PINTURA")
PER_PAGE, PER_ANNEXED_PAGE = 6, 5


def _book_lines(t) -> DataFrame:
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    rows = t.lineitem.select(
        F.col("l_partkey").alias("doc_id"), "l_orderkey", "l_linenumber", (F.row_number().over(order) - 1).alias("k"), F.count("*").over(Window.partitionBy("l_partkey")).cast("int").alias("n"), "l_quantity",
        F.lag("l_orderkey").over(order).alias("before"), F.lag("l_quantity").over(order).alias("quantity_before"),
    )
    worth = lambda q, k: F.round(F.col(q) + (k % 7) * 0.05, 2)
    return rows.select("*", worth("l_quantity", F.col("k")).alias("q"), worth("quantity_before", F.col("k") - 1).alias("q0"), (F.col("doc_id") % 4).alias("kind"), (F.floor(F.col("k") / 4) % 3 + 1).cast("int").alias("c"))


def budget_pages(t) -> DataFrame:
    """(doc_id, page_no, text): a budget for each part, of four kinds by its key.

    0: items beside their descriptions, some of which go on overleaf, with totals carried over at the head of a page
    and chapters that change their name. 1: descriptions in the first half, some cut off at a page's foot, quantities in
    the second, some codes twice. 2: hardly any descriptions. 3: prose.
    """
    b = _book_lines(t)
    k, n, c = F.col("k"), F.col("n"), F.col("c")
    number = lambda q: F.replace(F.format_string("%.2f", q), F.lit("."), F.lit(","))
    unit = F.element_at(F.array(*map(F.lit, ("m2", "Ud", "ml"))), (k % 3).cast("int") + 1)
    name = F.concat(F.element_at(F.array(*map(F.lit, CHAPTERS)), c), F.when(k >= 12, " Y VARIOS").otherwise(""))
    heading = F.when(k % 4 == 0, F.concat(F.lit("C0"), c, F.lit(" Capítulo "), name))
    code = F.concat(F.lit("C0"), c, F.lit("."), F.lpad((k + 1).cast("string"), 3, "0"))
    item = F.concat(code, F.lit(" Partida "), unit, F.lit(" LÍNEA "), k + 1)
    described = F.concat(F.lit("Suministro y colocación de la línea "), k + 1, F.lit(" con medios auxiliares y limpieza final."))
    foot = lambda size: (k % size == size - 1) & (F.col("l_orderkey") % 2 == 0)
    head = lambda size: (k % size == 0) & (F.col("before") % 2 == 0)
    overleaf = F.when(head(PER_PAGE), F.concat(F.lit("Suministro y montaje que sigue de la línea "), k, F.lit(" según planos de la obra.")))
    table = F.when((k == 0) & (F.col("doc_id") % 8 == 0), F.lit("Código Ud Resumen"))
    carried = F.when((k % PER_PAGE == 0) & (k > 0), number(F.col("q0")))
    block = lambda *lines: F.array_join(F.array_compact(F.array(*lines)), "\n")
    inline = block(table, overleaf, heading, item, F.when(~foot(PER_PAGE), described), carried, number(F.col("q")))
    remains = F.when(head(PER_ANNEXED_PAGE), F.concat(F.lit("los remates de la línea "), k, F.lit(".")))
    cut = F.when(foot(PER_ANNEXED_PAGE), F.concat(F.lit("Suministro y montaje de la línea "), k + 1, F.lit(" incluyendo"))).otherwise(described)
    bare, counted = F.replace(code, F.lit("."), F.lit("-")), lambda more: F.concat(number(F.col("q") + more), F.lit(" "), unit)
    twice = F.when(F.col("l_linenumber") == 1, F.concat_ws("\n", bare, counted(1)))
    halves = F.array(F.struct(F.lit(0).alias("half"), block(remains, heading, item, cut).alias("text")), F.struct(F.lit(1).alias("half"), block(bare, counted(0), twice).alias("text")))
    other = F.when(F.col("kind") == 0, inline).when(F.col("kind") == 2, block(item, F.lit("Pieza."), number(F.col("q")))).otherwise(F.concat(F.lit("Texto de la línea "), k + 1, F.lit(" sin partida alguna.")))
    parts = F.when(F.col("kind") == 1, halves).otherwise(F.array(F.struct(F.lit(0).alias("half"), other.alias("text"))))
    rows = b.select("doc_id", "k", "n", "kind", F.explode(parts).alias("x"))
    own = F.when(F.col("kind") == 1, F.col("x.half") * F.ceil(n / PER_ANNEXED_PAGE) + F.floor(k / PER_ANNEXED_PAGE)).otherwise(F.floor(k / PER_PAGE)) + 1
    blocks = rows.select("doc_id", own.cast("int").alias("page_no"), F.struct("k", "x.text").alias("s"))
    return blocks.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]), "\n").alias("text"))


#: A document's layout and confidence, as its kind and number of lines make it.
ROUTES = f"""WITH {LINES},
d AS (SELECT doc_id, kind, n, CASE WHEN kind = 3 OR n < 3 THEN 'UNKNOWN' WHEN kind = 1 AND n >= 11 THEN 'TWO_PHASE_ANNEXED' ELSE 'INLINE_WITH_TITLES' END AS layout,
  CAST(CASE WHEN kind = 3 OR n < 3 THEN 0.6 WHEN kind = 1 AND n >= 11 THEN 0.85 WHEN n >= 20 THEN 0.9 WHEN kind = 0 AND doc_id % 8 = 0 THEN 0.85 ELSE 0.65 END AS DOUBLE) AS confidence
  FROM (SELECT DISTINCT doc_id, kind, n FROM b))"""
NAMES_SQL = "CASE c WHEN 1 THEN 'TRABAJOS PREVIOS' WHEN 2 THEN 'ALBAÑILERIA' ELSE 'PINTURA' END"


@query(f"""{ROUTES},
ch AS (SELECT doc_id, c, count(*) AS items, max(k) >= 12 AS varied FROM b WHERE kind < 2 GROUP BY 1, 2),
named AS (SELECT doc_id, string_agg('C0' || c || ' ' || {NAMES_SQL} || ' ' || items, '; ' ORDER BY c) AS chapters,
  string_agg('C0' || c || ': ' || {NAMES_SQL} || ' | ' || {NAMES_SQL} || ' Y VARIOS', '; ' ORDER BY c) FILTER (WHERE varied) AS anomalies FROM ch GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_cross, string_agg((k // 6 + 1) || ' C0' || c || '.' || lpad(CAST(k + 1 AS VARCHAR), 3, '0'), '; ' ORDER BY k) AS cross_page
  FROM b WHERE kind = 0 AND k % 6 = 5 AND l_orderkey % 2 = 0 AND k < n - 1 GROUP BY 1)
SELECT doc_id, CAST(CASE WHEN kind = 1 THEN 2 * ((n + 4) // 5) ELSE (n + 5) // 6 END AS INT) AS n_pages, true AS extractable, layout, confidence, CASE WHEN kind = 3 THEN 0 ELSE n END AS n_items,
  CAST(CASE WHEN kind = 3 THEN 0 ELSE n END - coalesce(n_cross, 0) AS INT) AS n_plain, CAST(coalesce(n_cross, 0) AS INT) AS n_needs_model,
  coalesce(chapters, '') AS chapters, coalesce(cross_page, '') AS cross_page, coalesce(anomalies, '') AS anomalies
FROM d LEFT JOIN named USING (doc_id) LEFT JOIN x USING (doc_id)""")
def pipe_layout_fingerprint(t) -> DataFrame:
    """Structure, items that go on overleaf and chapters with several names, of every budget."""
    f = layout.fingerprint(budget_pages(t))
    listed = lambda c, text: F.array_join(F.transform(c, text), "; ").alias(c)
    return f.select(
        "doc_id", "n_pages", "extractable", "layout", "confidence", "n_items", "n_plain", "n_needs_model",
        listed("chapters", lambda x: F.concat_ws(" ", x["prefix"], x["name"], x["n_items"])),
        listed("cross_page", lambda x: F.concat_ws(" ", x["page_no"], x["code"])),
        listed("anomalies", lambda x: F.concat(x["prefix"], F.lit(": "), F.array_join(x["names"], " | "))),
    )


@query(f"""{ROUTES},
r AS (SELECT *, CASE WHEN layout = 'TWO_PHASE_ANNEXED' THEN 'annexed' WHEN layout = 'UNKNOWN' OR confidence < 0.85 OR kind = 2 THEN 'model' ELSE 'inline' END AS route,
  CASE WHEN layout = 'UNKNOWN' THEN 'layout' WHEN confidence < 0.85 THEN 'confidence' WHEN kind = 2 THEN 'short_descriptions' END AS reason FROM d),
i AS (SELECT b.*, r.route, CASE k % 3 WHEN 0 THEN 'm2' WHEN 1 THEN 'Ud' ELSE 'ml' END AS unit,
  'Suministro y colocación de la línea ' || (k + 1) || ' con medios auxiliares y limpieza final.' AS described, l_orderkey % 2 = 0 AS even FROM b JOIN r USING (doc_id) WHERE route <> 'model'),
w AS (SELECT *, CASE WHEN route = 'annexed' THEN CASE WHEN k % 5 = 4 AND even THEN 'Suministro y montaje de la línea ' || (k + 1) || ' incluyendo' || CASE WHEN k < n - 1 THEN ' los remates de la línea ' || (k + 1) || '.' ELSE '' END ELSE described END
  ELSE CASE WHEN k % 6 = 5 AND even THEN 'LÍNEA ' || (k + 1) ELSE described
    || CASE WHEN (k + 1) % 4 = 0 AND (k + 1) % 6 <> 0 AND k < n - 1 THEN ' C0' || (((k + 1) // 4) % 3 + 1) || ' Capítulo '
      || CASE ((k + 1) // 4) % 3 WHEN 0 THEN 'TRABAJOS PREVIOS' WHEN 1 THEN 'ALBAÑILERIA' ELSE 'PINTURA' END || CASE WHEN k + 1 >= 12 THEN ' Y VARIOS' ELSE '' END ELSE '' END END END AS description FROM i)
SELECT doc_id, route, NULL AS reason, CAST(k // CASE WHEN route = 'annexed' THEN 5 ELSE 6 END + 1 AS INT) AS page_no, 'C0' || c || '.' || lpad(CAST(k + 1 AS VARCHAR), 3, '0') AS code, unit, lower(unit) AS unit_normalized,
  CASE unit WHEN 'm2' THEN 'superficie' WHEN 'ml' THEN 'lineal' ELSE 'discreto' END AS unit_dimension, 'C0' || c || ' ' || {NAMES_SQL} AS chapter, description,
  CAST(round(q + CASE WHEN route = 'annexed' AND l_linenumber = 1 THEN 1 ELSE 0 END, 2) AS DOUBLE) AS quantity FROM w
UNION ALL SELECT doc_id, route, reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE route = 'model'""")
def pipe_layout_extract(t) -> DataFrame:
    """Items of both layouts, and the budgets that need a model with the gate that stopped them."""
    out = layout.extract_documents(stored(budget_pages(t), "pages"))
    return out.withColumn("quantity", F.round("quantity", 2))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lead(trim(substr(text, 1, 20))) OVER (PARTITION BY conv_id ORDER BY turn) AS tail,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after, left(text, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS z FROM conversations)
SELECT conv_id, turn, 1 AS item, a AS description FROM l
UNION ALL SELECT conv_id, turn, 2, CASE WHEN role = 'user' AND after = 'assistant' AND tail <> '' THEN rtrim(z) || ' ' || tail ELSE z END FROM l""")
def win_lead_lag_merge(t) -> DataFrame:
    """Two items a page (turn): the last one of a truncated page (a user's) takes over the tail that opens the next (an assistant's)."""
    c = t.conversations
    half = F.floor(F.length("text") / 2).cast("int")
    items = c.select("conv_id", "turn", F.posexplode(F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))).alias("item", "description"))
    pages = c.select("conv_id", "turn", (F.col("role") == "user").alias("truncated"), F.when(F.col("role") == "assistant", F.substring("text", 1, 20)).alias("tail"))
    merged = ordered.merge_tails(items, pages, ["conv_id"], "turn", "item", "description")
    return merged.select("conv_id", "turn", (F.col("item") + 1).alias("item"), "description")


def price_books(t) -> DataFrame:
    """(doc_id, text): a price book for each brand, its parts as items with sections, page feet, components and long descriptions."""
    euros = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    unit = F.when(F.col("p_size") % 2 == 0, "m²").otherwise("h")
    section = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("DEMOLICIONES\n"), F.upper("p_type")))
    code = F.concat(F.lit("DQC"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.when(F.col("p_size") % 3 == 0, "b").otherwise(""))
    opening = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.upper(code), F.lit(" ud "), F.col("p_name"), F.lit(" "), euros)).otherwise(F.concat(code, F.lit(" "), unit, F.lit(" "), euros, F.lit(" "), F.col("p_name")))
    more = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("  incluso parte proporcional de "), F.lower("p_type"), F.lit(", carga y retirada")))
    foot = F.when(F.col("p_partkey") % 10 == 3, F.concat(F.lit("Exterior Forjados -- "), F.col("p_size"), F.lit(" of 407 --")))
    junk = F.when(F.col("p_partkey") % 11 == 1, F.lit("CUADRO DE PRECIOS Página"))
    last = F.when(F.col("p_size") % 8 == 1, F.lit("y limpieza. mt50spa200 tabla"))
    parts = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("p_size") % 4), lambda i: F.concat(F.lit("mo"), F.format_string("%03d", i + 100), F.lit(" h peón "), i))
    text = F.concat_ws("\r\n", section, opening, more, junk, F.array_join(parts, "\r\n"), foot, last)
    rows = t.part.select(F.col("p_brand").alias("doc_id"), F.struct("p_partkey", text.alias("x")).alias("s"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]), "\r\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("Libro de ejemplo\r\n\r\n"), body).alias("text"))


@query("""WITH p AS (SELECT p_brand AS doc_id, p_partkey AS k, p_size, p_name, p_retailprice, upper(p_type) AS section, lower(p_type) AS low,
    'DQC' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || CASE WHEN p_size % 3 = 0 THEN 'b' ELSE '' END AS code FROM part)
SELECT doc_id, CAST(row_number() OVER w AS INT) AS item_no, last_value(CASE WHEN k % 5 = 0 THEN section END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section,
  CASE WHEN k % 7 = 0 THEN upper(code) ELSE code END AS code, CASE WHEN k % 7 = 0 THEN 'ud' WHEN p_size % 2 = 0 THEN 'm²' ELSE 'h' END AS unit, p_retailprice AS price,
  p_name || CASE WHEN p_size % 4 > 0 THEN ' incluso parte proporcional de ' || low || ', carga y retirada' ELSE '' END || CASE WHEN p_size % 8 = 1 THEN ' y limpieza.' ELSE '' END AS description,
  CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'mo100 h peón 0' WHEN 2 THEN 'mo100 h peón 0; mo101 h peón 1' ELSE 'mo100 h peón 0; mo101 h peón 1; mo102 h peón 2' END AS components
FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k)""")
def scan_regex_text_parser(t) -> DataFrame:
    """Price books written as text and read back item by item."""
    return pricebooks.parse_books(price_books(t)).withColumn("components", F.array_join("components", "; "))


def _written(t) -> str:
    """Documents as files with pages of 25 lines, in a folder for each language; names tell date, source and version."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    paged = F.array_join(F.transform(F.sequence(F.lit(1), F.size(lines), F.lit(25)), lambda i: F.array_join(F.slice(lines, i, F.lit(25)), "\n")), "\f")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")), "yyyyMMdd")
    name = F.concat(day, F.lit(" Presupuesto "), F.col("source"), F.lit(" d"), F.col("doc_id"), F.lit(" V"), F.col("doc_id") % 5 + 1, F.lit(".pdf"))
    path = scratch_path(t.spark, "files")
    files.write_files(t.documents.select(F.col("lang").alias("folder"), name.alias("name"), paged.alias("text")), path)
    return path


FILE_SQL = """d AS (SELECT *, DATE '2024-01-01' + CAST(doc_id % 700 AS INT) AS day FROM documents),
f AS (SELECT doc_id, lang AS folder, strftime(day, '%Y%m%d') || ' Presupuesto ' || source || ' d' || doc_id || ' V' || (doc_id % 5 + 1) || '.pdf' AS name, day, source, coalesce(text, '') AS text FROM d)"""


@query(f"""WITH {FILE_SQL} SELECT folder, name, CAST(strlen(text) + 1 AS BIGINT) AS size, '.pdf' AS ext, day AS date, CAST(doc_id % 5 + 1 AS INT) AS version, 'd' || doc_id || '_' || source AS slug FROM f""")
def scan_files_dir(t) -> DataFrame:
    """Files of a folder and what their names say; none is opened."""
    found = names.parsed(files.list_files(t.spark, _written(t)), "name")
    return found.select("folder", "name", "size", "ext", "date", "version", "slug")


@query(f"""WITH {FILE_SQL}, l AS (SELECT folder, name, unnest(generate_series(1, len(ls))) AS n, unnest(ls) AS line FROM (SELECT folder, name, string_split(text, chr(10)) AS ls FROM f))
SELECT folder, name, CAST((n - 1) // 25 + 1 AS INT) AS page_no, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY n)) AS page_md5 FROM l GROUP BY 1, 2, 3""")
def scan_pdf_text(t) -> DataFrame:
    """Pages of the files of a folder, with their lines and a digest of the text."""
    texts = files.read_texts(t.spark, _written(t)).select(F.struct("folder", "name").alias("doc_id"), "text")
    pages = layout.text_pages(texts)
    return pages.select("doc_id.folder", "doc_id.name", "page_no", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), F.md5("text").alias("page_md5"))
