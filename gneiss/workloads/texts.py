"""String functions and layout rules over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import addresses, files, text, units
from gneiss.plans import layout
from gneiss.workloads.base import query


@query(r"SELECT p_partkey, lower(regexp_replace(p_brand || '-' || p_name, '[^A-Za-z0-9_]', '', 'g')) AS code FROM part")
def normalize_code_w(t) -> DataFrame:
    return t.part.select("p_partkey", text.normalize_code_word(F.concat("p_brand", F.lit("-"), "p_name")).alias("code"))


@query(r"SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS code FROM part")
def normalize_code_digits(t) -> DataFrame:
    return t.part.select("p_partkey", text.normalize_code_digits(F.col("p_brand")).alias("code"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, lpad(CAST(l_orderkey % 200 AS VARCHAR), CAST(greatest(2, length(CAST(l_orderkey % 200 AS VARCHAR))) AS INTEGER), '0') || '.' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS code FROM lineitem""")
def normalize_code_pad(t) -> DataFrame:
    raw = F.concat(F.lit("c"), (F.col("l_orderkey") % 200).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.normalize_code_pad(raw).alias("code"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE lpad(CAST(p_size % 20 AS VARCHAR), 2, '0') END AS chapter FROM part""")
def chapter_code_of(t) -> DataFrame:
    """Codes with zeros before them, blanks around them, of chapter 0, and without a dot."""
    code = F.concat(F.when(F.col("p_partkey") % 3 == 0, " 0").otherwise("0"), (F.col("p_size") % 20).cast("string"), F.when(F.col("p_partkey") % 5 == 0, " ").when(F.col("p_partkey") % 7 == 0, " .1").otherwise(".1"))
    return t.part.select("p_partkey", text.chapter_code_of(code).alias("chapter"))


@query("SELECT p_partkey, upper(string_split(p_name, ' ')[1]) AS prefix, 'C' || p_size AS coded FROM part")
def chapter_prefix(t) -> DataFrame:
    coded = F.concat(F.lit("c "), F.col("p_size").cast("string"), F.lit(" "), "p_name")
    return t.part.select("p_partkey", F.upper(F.split("p_name", " ")[0]).alias("prefix"), text.chapter_prefix(coded).alias("coded"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE u WHEN 'm²' THEN 'm2' WHEN 'Uds' THEN 'ud' WHEN 'kgs' THEN 'kg' WHEN 'Hora' THEN 'h' END AS unit,
  CASE u WHEN 'm²' THEN 'superficie' WHEN 'Uds' THEN 'discreto' WHEN 'kgs' THEN 'masa' WHEN 'Hora' THEN 'tiempo' END AS dimension
  FROM (SELECT *, list_extract([' m² ', 'Uds', 'kgs', 'Hora', 'zzz'], CAST(l_partkey % 5 AS INTEGER) + 1) AS raw, trim(raw) AS u FROM lineitem)""")
def unit_normalize(t) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, (" m² ", "Uds", "kgs", "Hora", "zzz"))), (F.col("l_partkey") % 5).cast("int") + 1)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", units.unit_normalize(raw).alias("unit"), units.unit_dimension(raw).alias("dimension"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE l_partkey % 4 WHEN 0 THEN l_quantity * 1000 WHEN 1 THEN l_quantity * 0.25 WHEN 2 THEN l_quantity / 0.25 END, 6) AS converted FROM lineitem""")
def unit_convert(t) -> DataFrame:
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 4).cast("int") + 1)
    bridge = F.create_map(F.lit("thickness_m"), F.lit(0.25))
    converted = units.unit_convert(F.col("l_quantity"), pick("t", "m2", "m3", "h"), pick("kg", "m3", "m2", "m2"), bridge)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(converted, 6).alias("converted"))


INJECTION_SQL = ", ".join(f"'{p}'" for p in text.INJECTIONS)


@query(rf"""WITH s AS (SELECT doc_id, substring(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F]', ' ', 'g'), '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{FEFF}}]', '', 'g'), ' '), 1, 5000) AS s FROM documents)
SELECT doc_id, length(s) AS n, list_filter([{INJECTION_SQL}], lambda p: regexp_matches(s, p, 'i')) AS matched FROM s""")
def sanitize_text(t) -> DataFrame:
    """Clean text and the patterns of prompt injection that it matches; texts are cut to 5,000 characters by the operator."""
    clean = t.documents.select("doc_id", text.sanitize(F.coalesce("text", F.lit(""))).alias("s"))
    return clean.select("doc_id", F.length("s").cast("bigint").alias("n"), text.injections(F.col("s")).alias("matched"))


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN substring(text, 1, 3997) || '…' ELSE text END AS reply FROM documents")
def output_guardrail(t) -> DataFrame:
    return t.documents.select("doc_id", text.cut(F.col("text")).alias("reply"))


STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(f"""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-záéíóúñü0-9]{{3,}}')), lambda x: x NOT IN ({STOP_SQL}))) AS n_tokens FROM documents""")
def token_set(t) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.token_set(F.col("text"))).cast("bigint").alias("n_tokens"))


@query(f"""WITH n AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
w AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(CASE WHEN length(x) <= length(y) THEN x ELSE y END), '[a-záéíóúñü0-9]{{3,}}')), lambda x: x NOT IN ({STOP_SQL})) AS a,
  list_filter(list_distinct(regexp_extract_all(lower(CASE WHEN length(x) <= length(y) THEN y ELSE x END), '[a-záéíóúñü0-9]{{3,}}')), lambda x: x NOT IN ({STOP_SQL})) AS b FROM n)
SELECT item_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / greatest(len(a), 4) END, 6) AS coverage FROM w""")
def token_coverage(t) -> DataFrame:
    """How much of an item's words the next one has, or the other way round: of the shorter of the two."""
    b = t.benchmark.select("item_id", "text")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    first = F.length("text") <= F.length("other")
    short, long = F.when(first, F.col("text")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("text"))
    return pairs.select("item_id", F.round(text.token_coverage(short, long), 6).alias("coverage"))


@query("""SELECT p_partkey, round(len(list_filter(['red', 'small', 'widget'], lambda x: contains(lower(p_name), x))) / 3.0, 6) AS score FROM part""")
def keyword_score(t) -> DataFrame:
    return t.part.select("p_partkey", F.round(text.keyword_score(F.lit("red of small widget"), F.col("p_name")), 6).alias("score"))


@query("""WITH s AS (SELECT p_partkey, len(list_filter(['red', 'small', 'ring'], lambda x: contains(lower(p_name || ' ' || p_brand), x))) AS score FROM part)
SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 25""")
def labor_keyword_rank(t) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    score = F.size(F.filter(F.array(*map(F.lit, ("red", "small", "ring"))), lambda w: F.contains(hay, w))).cast("bigint")
    return t.part.select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(25)


@query("""SELECT c_custkey, list_sort(list_distinct(list_filter(string_split(lower(c_name || ' ' || c_mktsegment), ' '), lambda x: length(x) > 2))) AS slug,
  coalesce(TRY_CAST(regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1) AS BIGINT), 0) AS version FROM customer""")
def slug_tokens(t) -> DataFrame:
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), " "), lambda w: F.length(w) > 2)
    version = F.regexp_extract("c_name", "#0*([1-9][0-9]*)$", 1).try_cast("bigint")
    return t.customer.select("c_custkey", F.sort_array(F.array_distinct(words)).alias("slug"), F.coalesce(version, F.lit(0)).alias("version"))


DISPOSABLE_SQL = ", ".join(f"'{d}'" for d in addresses.DISPOSABLE)


@query(f"""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'example.com' ELSE list_extract([{DISPOSABLE_SQL}], CAST(c_custkey % 80 AS INTEGER) + 1) END AS domain FROM customer)
SELECT c_custkey, domain, c_custkey % 3 <> 0 AND domain IS NOT NULL AS disposable FROM d""")
def email_domain_disposable(t) -> DataFrame:
    """Domain of an address, and whether it is one of the throw-away ones."""
    listed = F.get(F.array(*(F.lit(d.upper()) for d in addresses.DISPOSABLE)), (F.col("c_custkey") % 80).cast("int"))
    email = F.concat(F.lit("a.b@"), F.when(F.col("c_custkey") % 3 == 0, "Example.com").otherwise(listed), F.lit(" "))
    return t.customer.select("c_custkey", addresses.domain(email).alias("domain"), addresses.is_disposable(email).alias("disposable"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS value FROM lineitem""")
def parse_es_number(t) -> DataFrame:
    """Written the Spanish way and read back."""
    written = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.parse_es_number(written).alias("value"))


@query("""SELECT p_partkey, replace(replace(replace(format('{:,.2f}', p_retailprice), ',', '#'), '.', ','), '#', '.') || ' €' AS price FROM part""")
def fmt_eur(t) -> DataFrame:
    return t.part.select("p_partkey", text.format_eur(F.col("p_retailprice")).alias("price"))


@query("SELECT o_orderkey, list_extract(['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'], CAST(month(o_orderdate) AS INTEGER)) || ' ' || year(o_orderdate) AS label FROM orders")
def month_label_es(t) -> DataFrame:
    from gneiss.workloads.finance import MONTHS

    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("o_orderdate"))
    return t.orders.select("o_orderkey", F.concat(name, F.lit(" "), F.year("o_orderdate").cast("string")).alias("label"))


@query(r"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits, CASE WHEN length(coalesce(text, '')) = 0 THEN FALSE ELSE length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) > 0.35 END AS noisy FROM documents""")
def digit_ratio(t) -> DataFrame:
    s = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.length(F.regexp_replace(s, "[^0-9]", "")).cast("bigint").alias("digits"), (text.digit_ratio(s) > 0.35).alias("noisy"))


@query(r"SELECT p_partkey, trim(regexp_replace('[' || p_brand || '] ' || p_name || ' [x]', '\[.*?\]', '', 'g')) AS query FROM part")
def clean_query_brackets(t) -> DataFrame:
    return t.part.select("p_partkey", text.strip_brackets(F.concat(F.lit("["), "p_brand", F.lit("] "), "p_name", F.lit(" [x]"))).alias("query"))


@query("""SELECT p_partkey, list_sort(list_distinct([p_name, regexp_replace(p_name, 'red', 'crimson'), regexp_replace(p_name, 'ring', 'band')])) AS variations FROM part""")
def query_variation(t) -> DataFrame:
    once = lambda a, b: F.when(F.contains("p_name", F.lit(a)), F.concat(F.substring_index("p_name", a, 1), F.lit(b), F.substring(F.col("p_name"), F.instr("p_name", a) + len(a), F.length("p_name")))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", F.sort_array(F.array_distinct(F.array("p_name", once("red", "crimson"), once("ring", "band")))).alias("variations"))


@query("""WITH c AS (SELECT l_orderkey, 2 * any_value(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) + least(count(*) FILTER (WHERE l_returnflag = 'A'), 10) AS price, count(*) FILTER (WHERE l_returnflag = 'R') AS measured FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT l_orderkey, CAST(price AS BIGINT) AS price_score, measured AS measurement_score, CASE WHEN price >= 3 THEN 'OUTPUT' WHEN (price = 0 AND measured >= 3) OR (price <= 2 AND measured >= 5) THEN 'INPUT' ELSE 'UNKNOWN' END AS role FROM c""")
def classify_price_doc(t) -> DataFrame:
    """Whether a document made of an order's lines has prices or measurements."""
    line = F.when(F.col("l_returnflag") == "A", "Solado de gres 1.234,56 €").when(F.col("l_returnflag") == "R", "Solado de gres 12,5 M2 ").otherwise("Solado de gres")
    texts = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    head = F.when(F.col("o_orderstatus") == "P", "TOTAL PRESUPUESTO\n").otherwise("")
    docs = texts.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", layout.price_role(F.concat(head, "body")).alias("r"))
    return docs.select("l_orderkey", F.col("r.price_score").cast("bigint").alias("price_score"), F.col("r.measurement_score").cast("bigint").alias("measurement_score"), "r.role")


VERB_SQL = ", ".join(f"'{v.lower()}'" for v in layout.WORK_VERBS)


@query(f"""WITH l AS (SELECT p_partkey, list_extract([{VERB_SQL}, 'licensed', 'para'], CAST(p_partkey % 40 AS INTEGER) + 1) AS verb, p_name FROM part)
SELECT p_partkey, coalesce(length(verb || 's de ' || p_name || ' en obra') >= 30 AND verb NOT IN ('licensed', 'para'), FALSE) AS is_work FROM l""")
def work_verb_line(t) -> DataFrame:
    """Lines of 30 characters or more that open with a word of work, whatever its case."""
    verbs = F.array(*(F.lit(v.upper()) for v in layout.WORK_VERBS), F.lit("Licensed"), F.lit("Para"))
    line = F.concat(F.lit("  "), F.get(verbs, (F.col("p_partkey") % 40).cast("int")), F.lit("s de "), "p_name", F.lit(" en obra "))
    return t.part.select("p_partkey", F.coalesce(layout.work_line(line), F.lit(False)).alias("is_work"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'item_coded' WHEN 1 THEN 'item_numbered' WHEN 2 THEN 'chapter_coded' WHEN 3 THEN 'chapter_numbered' WHEN 4 THEN 'quantity' WHEN 5 THEN 'quantity' END AS family FROM part""")
def regex_family_layout(t) -> DataFrame:
    """The family of budget lines that each line belongs to."""
    key = F.col("p_partkey").cast("string")
    forms = (
        F.concat(F.lit("C04."), key, F.lit(" Partida m² "), "p_name"), F.concat(F.lit("1."), key, F.lit(".03 Ud "), "p_name"), F.concat(F.lit("C"), key, F.lit(" Capitulo "), F.upper("p_name")),
        F.concat(key, F.lit(" OBRA CIVIL, Y MUROS")), F.concat(key, F.lit(",25 kg")), F.concat(key, F.lit(".5 ")), F.concat(F.lit("Partida "), key, F.lit(" m2 "), "p_name"),
    )
    return t.part.select("p_partkey", layout.line_family(F.get(F.array(*forms), (F.col("p_partkey") % 7).cast("int"))).alias("family"))


@query(r"""WITH k AS (SELECT unnest(['table', 'href', 'script']) AS pattern) SELECT pattern, count(*) AS n_pages, round(avg(len(regexp_extract_all(html, pattern))), 6) AS per_page FROM pages, k WHERE contains(html, pattern) GROUP BY 1""")
def pattern_frequency(t) -> DataFrame:
    k = t.pages.select("html", F.explode(F.array(*map(F.lit, ("table", "href", "script")))).alias("pattern")).where(F.contains("html", F.col("pattern")))
    return k.groupBy("pattern").agg(F.count("*").alias("n_pages"), F.round(F.avg(F.regexp_count("html", F.col("pattern"))), 6).alias("per_page"))


@query("""SELECT p_brand, string_agg(p_name, ' / ' ORDER BY p_partkey) AS merged FROM part GROUP BY 1""")
def merge_chapters_by_name(t) -> DataFrame:
    """Lists concatenated in page order."""
    rows = t.part.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    return rows.select("p_brand", F.array_join(F.transform("x", lambda s: s["p_name"]), " / ").alias("merged"))


@query("SELECT p_type, CASE WHEN contains(all_names, 'widget') THEN 'widget' WHEN contains(all_names, 'ring') THEN 'ring' ELSE 'other' END AS kind FROM (SELECT p_type, string_agg(p_name, ' ') AS all_names FROM part GROUP BY 1)")
def project_type_detect(t) -> DataFrame:
    has = lambda w: F.bool_or(F.contains("p_name", F.lit(w)))
    return t.part.groupBy("p_type").agg(F.when(has("widget"), "widget").when(has("ring"), "ring").otherwise("other").alias("kind"))


#: How file names of budgets are made up here: a date or none, a project, a version or none, a kind of file.
_NAMES_SQL = """WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '20241345_' ELSE '20' || (20 + c_custkey % 6) || '-0' || (1 + c_custkey % 9) || '-1' || (c_custkey % 9) || '_' END AS d,
  'PPTO ' || c_mktsegment || ' Nave-' || c_nationkey AS project, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '_v' || (1 + c_custkey % 5) ELSE ' rev 0' || (1 + c_custkey % 3) END AS version,
  list_extract(['.pdf', '.xlsx', '.bc3', '.zip'], CAST(c_custkey % 4 AS INTEGER) + 1) AS ext FROM customer),
p AS (SELECT c_custkey, ext, CASE WHEN d IN ('', '20241345_') THEN NULL ELSE CAST(left(d, 10) AS DATE) END AS date,
  CASE WHEN version = '' THEN 0 ELSE CAST(regexp_extract(version, '[0-9]+', 0) AS BIGINT) END AS version,
  array_to_string(list_sort(list_distinct(list_filter(string_split(lower(replace(project, '-', ' ')), ' '), lambda x: x <> 'ppto'))), '_') AS slug FROM f) """


def _files(t) -> DataFrame:
    key = F.col("c_custkey")
    date = F.when(key % 3 == 0, "").when(key % 7 == 0, "20241345_").otherwise(F.format_string("20%d-0%d-1%d_", 20 + key % 6, 1 + key % 9, key % 9))
    version = F.when(key % 4 == 0, "").when(key % 4 == 1, F.format_string("_v%d", 1 + key % 5)).otherwise(F.format_string(" rev 0%d", 1 + key % 3))
    ext = F.get(F.array(*map(F.lit, (".pdf", ".xlsx", ".bc3", ".zip"))), (key % 4).cast("int"))
    name = F.concat(date, F.lit("PPTO "), "c_mktsegment", F.lit(" Nave-"), F.col("c_nationkey").cast("string"), version, ext)
    return files.parsed(t.customer.select("c_custkey", name.alias("name")), "name")


@query(_NAMES_SQL + "SELECT c_custkey, strftime(date, '%Y-%m-%d') AS date FROM p")
def date_prefix(t) -> DataFrame:
    """The date that a file's name begins with, null without one that exists."""
    return _files(t).select("c_custkey", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query(_NAMES_SQL + "SELECT c_custkey, version, slug FROM p")
def version_extract(t) -> DataFrame:
    """Version and project of a file's name."""
    return _files(t).select("c_custkey", F.col("version").cast("bigint").alias("version"), "slug")


@query(_NAMES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY date DESC NULLS LAST, version DESC, CASE ext WHEN '.pdf' THEN 3 WHEN '.xlsx' THEN 2 WHEN '.bc3' THEN 1 ELSE 0 END DESC, c_custkey) AS n FROM p WHERE ext <> '.zip')
SELECT c_custkey, slug, CASE WHEN n > 1 OR date IS NULL THEN '02-borradores-sin-cierre' WHEN year(date) >= 2025 THEN '00-golden-candidates-2025' ELSE '01-aprobados-pre-2025' END AS category FROM r
UNION ALL SELECT c_custkey, '_', '99-formato-raro' FROM p WHERE ext = '.zip'""")
def pipe_doc_classify_plan(t) -> DataFrame:
    """Which folder each file of a project goes to."""
    return files.plan(_files(t), "c_custkey").select("c_custkey", "slug", "category")


@query("SELECT c_custkey, 'Hola ' || c_name || ', {{other}} ' || c_mktsegment || c_mktsegment || ' ' AS prompt FROM customer")
def prompt_placeholder_replace(t) -> DataFrame:
    """Named places of a template filled in, all their occurrences; unknown ones stay, a null is left empty."""
    values = {"name": F.col("c_name"), "kind": F.col("c_mktsegment"), "none": F.lit(None).cast("string")}
    return t.customer.select("c_custkey", text.fill_template(F.lit("Hola {{name}}, {{other}} {{kind}}{{kind}} {{none}}"), values).alias("prompt"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 2 - c_custkey % 2 END AS n_items, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE '{"items": [' || '{"a": "x}", "b": {"c": ' || c_nationkey || '}}' || CASE WHEN c_custkey % 2 = 0 THEN ', {"a": "]"}' ELSE '' END || ']}' END AS fixed FROM customer""")
def json_salvage(t) -> DataFrame:
    """Whole objects of an answer that was cut off, as JSON again."""
    first = F.concat(F.lit('{"a": "x}", "b": {"c": '), F.col("c_nationkey").cast("string"), F.lit("}}"))
    tail = F.when(F.col("c_custkey") % 2 == 0, ', {"a": "]"}, {"a": "cut').otherwise(', {"a": {"b": 1')
    raw = F.when(F.col("c_custkey") % 4 == 3, F.lit('{"items": [{"a": ')).otherwise(F.concat(F.lit('{"items": ['), first, tail))
    return t.customer.select("c_custkey", text.salvage_json(raw).alias("s")).select("c_custkey", F.col("s.n_items").cast("bigint").alias("n_items"), F.col("s.fixed").alias("fixed"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{"items": [' || c_nationkey || ']}' ELSE '{"items": []}' END AS fixed FROM customer""")
def json_wrap_array(t) -> DataFrame:
    """A bare array as the only field of an object; anything else as it is."""
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("["), F.col("c_nationkey").cast("string"), F.lit("]"))).otherwise('{"items": []}')
    return t.customer.select("c_custkey", text.wrap_array(raw, "items").alias("fixed"))
