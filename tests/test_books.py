"""Budget documents by layout, price books and files, on small examples."""

import pytest
from pyspark.sql import functions as F

from gneiss.operators import ordered
from gneiss.plans import layout, pricebooks
from gneiss.sources import files

PAGE = "doc_id long, page_no int, text string"
LONG = "Suministro y colocación con medios auxiliares, limpieza y retirada de escombros."


def inline_book(n=6, short=0, verb=True):
    """A budget with a table head: ``short`` items lack a description; the last of page 1 goes on overleaf."""
    items = [f"C0{1 + k % 2}.{k:02d} Partida m2 TÍTULO {k}\n" + ("" if k < short else LONG + "\n") + f"{k + 1},50" for k in range(n)]
    overleaf = "Suministro y montaje de lo que sigue en la página" if verb else "sigue en la página anterior con todo lo demás"
    first = "Código Ud Resumen\nC01 Capítulo DEMOLICIONES\n" + "\n".join(items) + "\nC02.99 Partida ud ÚLTIMA\n1,00 Ud"
    return [first, f"\n{overleaf}\nC01 Capítulo DEMOLICIONES Y TIERRAS\n2 ACTUACIONES PREVIAS\nC02.98 Partida h OTRA\n{LONG}\n1,00\n2,00 h"]


def pages(spark, **books):
    return spark.createDataFrame([(int(k[1:]), i, t) for k, ts in books.items() for i, t in enumerate(ts, 1)], PAGE)


def test_fingerprint_counts_breaks_and_chapters(spark):
    df = pages(spark, d1=inline_book(), d2=inline_book(verb=False), d3=["", None], d4=["lorem ipsum " * 40])
    f = {r.doc_id: r for r in layout.fingerprint(df).collect()}
    one = f[1]
    assert (one.n_pages, one.extractable, one.layout, one.confidence, one.n_items, one.n_plain, one.n_needs_model) == (2, True, "INLINE_WITH_TITLES", 0.85, 8, 7, 1)
    assert [tuple(c) for c in one.cross_page] == [(1, "C02.99")]
    assert [tuple(c) for c in one.chapters] == [("C01", "DEMOLICIONES", 3, 1), ("2", "ACTUACIONES PREVIAS", 0, 2)]
    assert [(a.prefix, a.names) for a in one.anomalies] == [("C01", ["DEMOLICIONES", "DEMOLICIONES Y TIERRAS"])]
    assert (f[2].n_needs_model, f[2].n_plain) == (0, 8)
    assert (f[3].n_pages, f[3].extractable, f[3].layout, f[3].n_items, f[3].chapters) == (2, False, "UNKNOWN", 0, [])
    assert (f[4].layout, f[4].confidence) == ("UNKNOWN", 0.6)
    assert layout.fingerprint(df.where("false")).collect() == []


def test_gates_refuse_what_patterns_cannot_read(spark):
    few = ["Código Ud Resumen\n" + "\n".join(f"1.{k} Ud TÍTULO\n{LONG}\n1,00" for k in range(4))]
    doubtful = ["\n".join(f"1.{k} Ud TÍTULO\n{LONG}\n1,00" for k in range(8))]
    df = pages(spark, d1=inline_book(), d2=few, d3=doubtful, d4=inline_book(9, short=6), d5=["prosa " * 60])
    out = layout.extract_documents(df).collect()
    assert {(r.doc_id, r.reason) for r in out if r.route == "model"} == {(2, "few_items"), (3, "confidence"), (4, "short_descriptions"), (5, "layout")}
    items = {r.code: r for r in out if r.doc_id == 1}
    assert len(items) == 8 and {r.route for r in items.values()} == {"inline"}
    assert (items["C01.00"].chapter, items["C02.01"].chapter, items["C01.00"].description, items["C01.00"].quantity) == ("C01 DEMOLICIONES", "Sin Capítulo", LONG, 1.5)
    assert (items["C02.99"].description, items["C02.99"].unit_normalized, items["C02.99"].unit_dimension) == ("ÚLTIMA", "ud", "discreto")
    assert items["C02.98"].quantity == 2.0  # the first quantity repeats the total before and items["C02.98"].unit_dimension == "tiempo"


def test_an_item_that_had_only_a_carried_total_counts_one(spark):
    book = "Código Ud Resumen\n" + "\n".join(f"1.{k} Ud TÍTULO {k}\n{LONG}\n{q}" for k, q in enumerate(["72,80", "72,80\n1,00", "1,00", "2,00", "2,00\n2,00", "9,00"]))
    out = {r.code: r.quantity for r in layout.extract_documents(pages(spark, d1=[book])).collect()}
    assert out == {"1.0": 72.8, "1.1": 1.0, "1.2": 1.0, "1.3": 2.0, "1.4": 2.0, "1.5": 9.0}


def annexed_book():
    front = [
        "C01 Capítulo OBRA\nC01.01 Partida m2 PRIMERA\nSuministro y montaje incluyendo\nC01.02 Partida ud SEGUNDA\nDemolición que se corta al final de",
        "la página y termina aquí.\nC01.03 Partida m TERCERA\nPintura completa.",
        "huérfano que nadie espera\nC02 Capítulo OTRA\nC02.01 Partida ud CUARTA",
        "acaba overleaf.\nC02.02 Partida m3 QUINTA\nExcavación en zanja.",
    ]
    back = ["C01.01\n10,00 m2\n2,50 m2\nC01-02\n4,00", "C01.03\n1,00\nC01.03\n7,00 m", "C02.01\n3,00\nC9.99\n8,00", "totales\n5,00\n6,00\n7,00"]
    return front + back


def test_annexed_route_merges_tails_and_meets_on_digits(spark):
    out = {r.code: r for r in layout.extract_documents(pages(spark, d1=annexed_book())).collect()}
    assert {r.route for r in out.values()} == {"annexed"}
    assert out["C01.01"].description == "Suministro y montaje incluyendo" and out["C01.01"].quantity == 12.5
    assert out["C01.02"].description == "Demolición que se corta al final de la página y termina aquí." and out["C01.02"].quantity == 4.0
    assert out["C01.03"].description == "Pintura completa." and out["C01.03"].quantity == 7.0
    assert out["C02.01"].description == "acaba overleaf." and out["C02.01"].quantity == 3.0
    assert out["C02.02"].quantity == 0.0
    assert {c: r.chapter for c, r in out.items()} == {"C01.01": "C01 OBRA", "C01.02": "C01 OBRA", "C01.03": "C01 OBRA", "C02.01": "C02 OTRA", "C02.02": "C02 OTRA"}


@pytest.mark.parametrize("truncated, tail, expected", [(True, " cola ", "b cola"), (False, "cola", "b "), (True, "  ", "b "), (True, None, "b "), (None, "cola", "b ")])
def test_tails(spark, truncated, tail, expected):
    items = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "b "), (1, 7, 0, "c")], "d int, page int, n int, t string")
    notes = spark.createDataFrame([(1, 1, truncated, None), (1, 7, True, tail), (1, 9, False, None)], "d int, page int, truncated boolean, tail string")
    assert [r.t for r in ordered.merge_tails(items, notes, ["d"], "page", "n", "t").orderBy("page", "n").collect()] == ["a", expected, "c"]


def test_price_book_lines(spark):
    text = "\r\n".join([
        "Libro", "DQC010 m² 1,00 Antes de todo se descarta nada", "CUADRO DE PRECIOS", "DEMOLICIONES", "Forjados Demoliciones", "DQC040b m² 17,41 Desmontaje de cobertura",
        "  con medios manuales y carga", "mt50spa 0,5 ud tabla", "%02 medios", "Exterior PAVIMENTOS Exterior -- 364 of 407 --", "", "EHU010 u. Forjado de losa 1.234,50", "de canto 20 cm mt07aco020 2,00", "A1m3 -10,00 Abono", "x" * 70,
    ])
    out = pricebooks.parse_books(spark.createDataFrame([(1, text), (2, None), (3, "sin partidas\ncon líneas")], "doc_id long, text string")).orderBy("item_no").collect()
    assert [(r.doc_id, r.item_no, r.section, r.code, r.unit, r.price) for r in out] == [
        (1, 1, "Libro", "DQC010", "m²", 1.0), (1, 2, "Forjados Demoliciones", "DQC040b", "m²", 17.41), (1, 3, "Forjados Demoliciones", "EHU010", "u.", 1234.5), (1, 4, "Forjados Demoliciones", "A1", "m3", -10.0),
    ]
    assert out[1].description == "Desmontaje de cobertura con medios manuales y carga" and out[1].components == ["mt50spa 0,5 ud tabla", "%02 medios"]
    assert out[2].description == "Forjado de losa de canto 20 cm" and out[3].description == "Abono " + "x" * 70


def test_files_are_written_listed_and_read(spark, tmp_path):
    rows = [("a", "20240105 Obra V2.pdf", "uno\ndos\n"), ("a", "ñ %=x.txt", ""), ("b", "20240105 Obra V2.pdf", "tres\ftres")]
    files.write_files(spark.createDataFrame(rows, "folder string, name string, text string"), str(tmp_path / "f"))
    listed = files.list_files(spark, str(tmp_path / "f"))
    assert {(r.folder, r.name, r["size"]) for r in listed.collect()} == {(f, n, len(t.encode()) + 1) for f, n, t in rows}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert {(r.folder, r.name, r.text) for r in files.read_texts(spark, str(tmp_path / "f")).collect()} == set(rows)
    texts = files.read_texts(spark, str(tmp_path / "f")).where(F.col("folder") == "b")
    assert [(r.page_no, r.text) for r in layout.text_pages(texts.withColumn("doc_id", F.lit(1))).orderBy("page_no").collect()] == [(1, "tres"), (2, "tres")]
