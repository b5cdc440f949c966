import random

from gneiss.llm import licenses

SCHEMA = "doc_id long, text string, line string"


def found(spark, rows):
    return {(r.doc_id, r.line): r for r in licenses.scan_licenses(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()}


def test_every_template_finds_itself(spark):
    rows = [(i, f"some prose before\n{t}\nand after it", name) for i, (name, t) in enumerate((n, t) for n, ts in licenses.TEMPLATES.items() for t in ts)]
    got = found(spark, [r[:2] for r in rows])
    for i, _, name in rows:
        assert (got[i, 1].license, got[i, 1].confirmed, got[i, 1].n_missing) == (name, True, 0), name


def test_wording_decides(spark):
    got = found(
        spark,
        [
            (1, "This work is licensed under the GNU General Public License, version 2."),
            (2, "This work is licensed under the GNU General Public License, version 7."),
            (3, "He lost his driving licence on the way to the harbour and walked home in the rain instead."),
            (4, "text\nText above. Released under the MIT License. More text follows here"),
            (5, "LICENSED UNDER cc by-nc 4.0"),
        ],
    )
    assert (got[1, 0].license, got[1, 0].confirmed) == ("GPL-2.0", True)
    assert not got[2, 0].confirmed and "7" in got[2, 0].wording
    assert not got[3, 0].confirmed
    assert (got[4, 1].license, got[4, 1].confirmed) == ("MIT", True)
    assert (got[5, 0].license, got[5, 0].confirmed) == ("CC-BY-NC-4.0", True)


def test_a_wrapped_text_is_one_block(spark):
    words = licenses.TEMPLATES["MIT"][-1].split(" ")
    lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    got = found(spark, [(1, "\n".join(["Copyright (c) 2020 A", *lines, "", "code"]))])
    confirmed = [r for r in got.values() if r.confirmed]
    assert [(r.line, r.license) for r in confirmed] == [(1, "MIT")]


def test_published_forms(spark):
    mit, apache, mpl = licenses.TEMPLATES["MIT"][-1], licenses.TEMPLATES["Apache-2.0"][-1], licenses.TEMPLATES["MPL-2.0"][0]
    for cut in ("The above copyright", "THE SOFTWARE IS"):
        mit = mit.replace(cut, "\n\n" + cut)
    wrapped = mpl.replace("Public License", "Public\nLicense")
    rows = [
        (1, f"Copyright (c) 2020 A\n\n{mit}\n\ncode"),
        (2, "prose\n" + apache.replace(" at http", " at\n\n   http").replace(" Unless", "\n\nUnless")),
        (3, f"code\n * {wrapped}\ncode"),
        (4, "word " * 5000 + licenses.TEMPLATES["MIT"][-1] + " word" * 5000 + " " + mpl + " word" * 5000),
        (5, "Licensed under CC BY 4.0.\n" + mit),
        (6, "word " * 300 + licenses.TEMPLATES["Apache-2.0"][-1].replace("Licensed under", "Offered under")),
    ]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = sorted((r.doc_id, r.line, r.license) for r in licenses.scan_licenses(df).collect() if r.confirmed)
    assert got == [(1, 2, "MIT"), (2, 1, "Apache-2.0"), (3, 1, "MPL-2.0"), (4, 0, "MIT"), (4, 0, "MPL-2.0"), (5, 0, "CC-BY-4.0"), (5, 1, "MIT"), (6, 0, "Apache-2.0")]


def test_other_templates_bring_their_own_triggers(spark):
    df = spark.createDataFrame([(1, "a\nUse it\n\nas you please, always.", "")], SCHEMA)
    assert [(r.line, r.license, r.confirmed) for r in licenses.scan_licenses(df, templates={"X": ("Use it as you please, always.",)}).collect()] == [(1, "X", True)]


def test_odd_texts(spark):
    assert found(spark, [(1, None), (2, ""), (3, "no such word"), (4, "a\n" * 50_000)]) == {}
    rows = [(None, "Licensed under CC BY 4.0."), (7, "Licensed under CC BY 4.0."), (7, "Licensed under CC BY 4.0.")]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    assert [r.license for r in licenses.scan_licenses(df).collect()] == ["CC-BY-4.0"] * 3
    assert licenses.scan_licenses(df.where("false")).collect() == []


def plain_best(words, templates):
    """The template whose words differ least from the text's, by the word edit distance of whole texts."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    return min(((distance(t, words), name) for name, ts in templates.items() for t in ts), key=lambda x: x[0])


def test_recall_of_edited_and_rewrapped_texts(spark):
    """Long templates with words dropped, changed or added, blank lines and list marks: found, and as the nearest template."""
    rng = random.Random(11)
    long = [(n, licenses.normal(t)) for n, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 150]
    rows, truth = [], {}
    for i in range(160):
        name, words = rng.choice(long)
        rate = rng.choice([0.0, 0.02, 0.04])
        edited = []
        for w in words:
            if rng.random() >= rate or any(c.isdigit() for c in w) or w in ("lesser", "affero"):
                edited.append(w)
            elif rng.random() < 0.5:
                edited += [w, "also"] if rng.random() < 0.5 else ["other"]
        text, at = "", 0
        while at < len(edited):
            n = rng.randint(5, 14)
            text += " ".join(edited[at : at + n]) + rng.choice(["\n", "\n", "\n\n", "\n * "])
            at += n
        rows.append((i, f"Copyright 2020 X\n\n{text}\nint main() {{ return 0; }}\n" + "more prose here " * rng.randint(0, 50)))
        truth[i] = (name, edited)
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = {}
    for r in licenses.scan_licenses(df).where("confirmed").collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert sum(name in got.get(i, ()) for i, (name, _) in truth.items()) >= 0.95 * len(truth)
    templates = {n: [licenses.normal(t) for t in ts] for n, ts in licenses.TEMPLATES.items()}
    for i, (name, edited) in list(truth.items())[:40]:
        assert plain_best(edited, templates)[1] in got.get(i, {None}) or i not in got


def test_recall_falls_slowly_with_edits():
    """Long templates with words dropped, changed or added at a rate: how many are confirmed under their own name."""
    rng, scanner = random.Random(13), licenses.Scanner(licenses.TEMPLATES)
    long = [(n, licenses.normal(t)) for n, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 150]
    for rate, least in ((0.02, 0.97), (0.05, 0.9), (0.08, 0.5)):
        found = 0
        for _ in range(80):
            name, words = rng.choice(long)
            edited = [x for w in words for x in (rng.choice([[], ["other"], [w, "also"]]) if rng.random() < rate and not any(c.isdigit() for c in w) and w not in ("lesser", "affero") else [w])]
            found += any(r[1] == name and r[5] for r in scanner.scan(("preface\n" + " ".join(edited) + "\nafterword").encode()))
        assert found >= least * 80, (rate, found)


def test_a_block_is_ranked_by_what_templates_save():
    scanner = licenses.Scanner({"A": ("one two three four five six seven eight nine ten",), "B": ("one two three four five six seven eight nine ten eleven",)})
    for text, name in (("one two three four five six seven eight nine ten", "A"), ("one two three four five six seven eight nine ten eleven", "B")):
        assert [r[1] for r in scanner.scan(text.encode()) if r[5]] == [name]
    block = b"one two three four five six seven eight nine ten eleven"
    assert scanner.reduction(1, block) > scanner.reduction(0, block)


def test_a_long_line_of_seed_words_ends_soon():
    import time

    words = [w for t in licenses.TEMPLATES["MIT"] + licenses.TEMPLATES["GPL-3.0"] for w in licenses.normal(t)]
    rng = random.Random(3)
    text = " ".join(rng.choice(words) for _ in range(30_000)).encode()
    began = time.process_time()
    list(licenses.Scanner(licenses.TEMPLATES).scan(text))
    assert time.process_time() - began < 30


def test_full_texts_of_common_licenses(spark):
    names = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0")
    rows = []
    for i, name in enumerate(names):
        sentences = max(licenses.TEMPLATES[name], key=len).replace(". ", ".\n\n").replace("Redistributions ", "\n\n  1. Redistributions ")
        rows.append((i, f"Copyright (c) 2021, The Authors\nAll rights reserved.\n\n{sentences}\n"))
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(df).where("confirmed").collect()}
    assert got == {(i, name) for i, name in enumerate(names)}
