"""The ten training-data operators and the pipeline against brute force, with nulls, empty tables, repeats and long texts."""

import random
import re
import textwrap
import zlib
from pathlib import Path

import llm_brute as brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candlework.llm import html_text, lang_id, licences, lm, mixing, queries, token_counts, token_files
from candlework.llm.decontaminate import decontaminate
from candlework.llm.licence_texts import LICENCES, NOTICES
from candlework.llm.near_dup import near_duplicates
from candlework.llm.vectors import near_duplicate_vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPOKEN = {"xa": "der und haus weg lang sonne nacht wald schnee fluss", "xb": "the and house road long sun night wood snow river", "xc": "日 月 山 川 田 人 口 車 門 雨"}


def rows_of(frame, key):
    return {r[key]: r for r in frame.collect()}


def corpus(n=90, seed=7):
    """Texts of three made-up languages with exact copies, copies a few words apart, repeats and odd cases."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SPOKEN))
        stock = [f"{a}{b}" for a in SPOKEN[lang].split() for b in ("", *SPOKEN[lang].split()[:4])]
        if i > 10 and rng.random() < 0.4:
            words = out[rng.randrange(i)][1].split(" ")
            for _ in range(rng.choice((0, 1, 2, 4))):
                words[rng.randrange(len(words))] = rng.choice(stock)
        else:
            words = [rng.choice(stock) for _ in range(rng.randrange(1, 120))]
        out.append((i, " ".join(words), lang, rng.choice(("web", "web", "books", None)), 0))
    out += [(n, None, None, "web", None), (n + 1, "", "xa", None, 0), (n + 2, " \t\n ", None, "web", 3), (n + 3, "123 !? 456", "xb", "books", 10)]
    out += [(n + 4, "The Sun AND the\x0bNIGHT\x00é Ünder <|endoftext|> wood", "xb", "web", 1), (n + 5, "snow river " * 3000, "xb", "web", 1)]
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names the operators use inside."""
    frame = spark.createDataFrame(texts, DOCS)
    extra = "id t n l e h cls key root item items words fp span size of mix_source copies part ids start block held score lang_pred component_id _text _gone a b".split()
    return frame.withColumns({c: F.lit("clash") for c in extra}).repartition(3)


@pytest.fixture(scope="module")
def items(spark, texts):
    long = [t for _, t, *_ in texts if t and len(t.split()) > 30]
    rows = [(1, " ".join(long[0].split()[5:25])), (2, " ".join(long[3].upper().split()[2:12])), (10, "wood,  SNOW river"), (4, "never seen in any of the texts that are here at all"), (5, None), (6, ""), (1, " ".join(long[0].split()[5:25])), (None, "night")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("fp", F.lit(1))


OPERATORS = {
    "winnowing": lambda d: decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "licences": licences.scan,
    "near": near_duplicates,
    "lm": lambda d: lm.score(d, held_out=F.lit(False)),
    "counts": token_counts.token_counts,
    "mix": mixing.mix,
    "mixed": mixing.mixed,
    "lang": lambda d: lang_id.identify(d, lang_id.profiles(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_columns_and_repeated_rows(spark, name):
    found = OPERATORS[name](spark.createDataFrame([(None,) * 5] * 3 + [(1, "same text here", "xa", None, 0)] * 2, DOCS)).collect()
    # what repeats id and text is one row of decontamination; one source is mixed as it is
    assert len(found) == 2 if name == "winnowing" else 5


def test_winnowing(docs, texts, items):
    found = rows_of(decontaminate(docs, items), "doc_id")
    want = brute.winnowing([x[:2] for x in texts], [(r.item_id, r.text) for r in items.collect()])
    assert {k: (r.n_words, r.n_hit, r["items"]) for k, r in found.items()} == want
    assert any(x[1] for x in want.values()) and all(r.contaminated == (r.n_hit > 0) for r in found.values())


def test_winnowing_without_items(spark, docs, texts):
    found = decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(found) == len(texts) and not any(r.n_hit for r in found)


def test_token_files(spark, docs, texts, tmp_path):
    token_files.write_token_files(docs, f"file://{tmp_path}/ids")
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/ids")
    got = sorted(tuple(r) for r in token_files.with_crc32(rows).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute.token_rows([x[:2] for x in texts])
    one = rows.where("doc_id = 4").first()
    assert brute.tokenizer().decode(one.ids[:-1]) == texts[4][1] and one.ids[-1] == 2


def test_token_files_are_made_for_selective_reads(spark, tmp_path, monkeypatch):
    """Encodings, row groups, pages and their indexes as the files' footers tell; parts are ranges of ids, hot ids split."""
    rng = random.Random(4)
    rows = [(i if i % 3 else None, " ".join(rng.choice(SPOKEN["xb"].split()) + str(rng.randrange(300)) for _ in range(200))) for i in range(3000)]
    monkeypatch.setattr(token_files, "PART_BYTES", 400_000)
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/ids")
    files = sorted(Path(f"{tmp_path}/ids").glob("*.parquet"))
    assert 4 <= len(files) <= 14
    encodings, sizes, read = {}, [], []
    for f in files:
        meta = pq.read_metadata(f)
        for g in range(meta.num_row_groups):
            sizes.append(meta.row_group(g).total_byte_size)
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                encodings.setdefault(column.path_in_schema, set()).update(column.encodings)
                assert column.has_offset_index and (column.has_column_index or column.path_in_schema.startswith("ids")) and column.compression == "ZSTD"
        read.append(pq.read_table(f, columns=["doc_id", "n_tokens"]).to_pylist())
    assert max(sizes) < 2 * int(token_files.LAYOUT["parquet.block.size"])
    assert "RLE_DICTIONARY" in encodings["ids.list.element"] and "DELTA_BINARY_PACKED" in encodings["part_start"] and "DELTA_BINARY_PACKED" in encodings["doc_id"]
    assert sum(any(r["doc_id"] is None for r in rows) for rows in read) >= 2  # a third of the rows have no id, and they don't make one file
    got = sorted(tuple(r)[1:] for r in token_files.with_crc32(token_files.read_token_files(spark, f"file://{tmp_path}/ids")).collect())
    assert got == sorted(x[1:] for x in brute.token_rows(rows))


def test_token_files_of_nulls_repeats_and_nothing(spark, tmp_path):
    rows = [(None, None), (2, "b"), (2, "b"), (2, None), (1, "a\u0000b")]
    for k, some in enumerate((rows, [])):
        token_files.write_token_files(spark.createDataFrame(some, "doc_id long, text string"), f"file://{tmp_path}/{k}")
        got = token_files.with_crc32(token_files.read_token_files(spark, f"file://{tmp_path}/{k}")).collect()
        assert sorted(tuple(r)[1:] for r in got) == [x[1:] for x in brute.token_rows(some)]


def test_licences(spark):
    mit = LICENCES["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone Else\n\n" + mit.upper().replace(",", " ;")), (3, mit.replace("charge", "fee")), (4, f"Some prose.\n{NOTICES['MIT']}\n  released under the mit license\n{NOTICES['CC-BY-4.0']}"), (5, None), (6, "..."), (7, "x " * 50_000)]
    found = rows_of(licences.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence_id", F.lit("clash"))), "doc_id")
    assert [found[k].licence_id for k in range(1, 8)] == ["MIT", "MIT", None, None, None, None, None]
    assert (found[4].notice_ids, found[4].n_notices) == ("CC-BY-4.0,MIT", 2) and found[5].text_digest is None and found[6].text_digest is None
    spelled = rows_of(licences.scan(spark.createDataFrame([(1, "The License is free."), (2, "the LICENCE, is free")], "doc_id long, text string"), licences={"L": "the licence is free"}), "doc_id")
    assert [spelled[k].licence_id for k in (1, 2)] == ["L", "L"]


def test_licences_of_a_table_and_brute_force(spark, monkeypatch):
    """Canonical forms by plain Python for texts without titles or statements; known texts as a dictionary and as a table."""
    rng = random.Random(9)
    stock = "the licence free software copy of any person organisation favour non commercial copy's use 2.0 and/or".split()
    texts = [" ".join(rng.choice(stock) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    listed = {f"L{i}": t for i, t in enumerate(texts[:60])}

    def canonical(text):
        words = re.findall("[a-z0-9]+", text.lower())
        out = " " + "  ".join(words) + " "
        for a, b in licences.SPELLINGS.items():
            out = out.replace(licences.spaced(a), licences.spaced(b))
        return " ".join(out.split())

    by_form = {}
    for name, t in sorted(listed.items()):
        by_form.setdefault(canonical(t), name)
    vary = lambda t: rng.choice([t, t.upper(), t.replace(" ", ",  "), f"({t})\n\n"])
    docs = spark.createDataFrame([(i, vary(t)) for i, t in enumerate(texts)] + [(900, "the sun " * 40_000), (901, None)], "doc_id long, text string")
    want = {i: by_form.get(canonical(t)) for i, t in enumerate(texts)} | {900: None, 901: None}
    table = spark.createDataFrame(list(listed.items()), "licence_id string, text string")
    monkeypatch.setattr(licences, "MOST_KNOWN", 59)
    for known in (listed, table):
        assert {r.doc_id: r.licence_id for r in licences.scan(docs, licences=known, notices={}).collect()} == want
    assert sum(v is not None for v in want.values()) > 60


def test_licence_files_with_headers_and_wraps(spark):
    heads = ["", "Copyright (c) 2020 X\n\n", "{} License\n\nCopyright 2020 X\nAll rights reserved.\n\n", "The {} License ({})\r\n\r\nCopyright Jane Doe <j@x.y>\r\n\r\n"]
    titles = {"BSL-1.0": "Boost Software", "Unlicense": "", "Zlib": "zlib", "0BSD": "BSD Zero Clause", "BSD-2-Clause": "BSD 2-Clause", "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised"', "ISC": "ISC", "MIT": "MIT", "MIT-0": "MIT No Attribution"}
    rows, want = [], {}
    for name, title in titles.items():
        for width in range(60, 101):
            body = "\n\n".join(textwrap.fill(p, width) for p in LICENCES[name].split("\n\n"))
            for head in [""] if not title else heads if width % 10 == 0 else heads[1:2]:
                head = head if title == name or "({})" not in head else heads[2]
                want[len(rows)] = name
                rows.append((len(rows), head.format(title, title) + body))
    rows += [(-1, "MIT License"), (-2, "Copyright notice: the sun"), (-3, "notice: the sun")]
    found = rows_of(licences.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    assert {k: found[k].licence_id for k in want} == want
    assert found[-1].text_digest is not None and found[-2].text_digest != found[-3].text_digest


def test_long_licences_and_other_notices(spark):
    files = {p.stem: p.read_text() for p in (Path(licences.__file__).parent / "licence_files").glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(files)
    rows = [(name, "\n\n".join(p if "copyright (c)" in p.lower() or "Copyright [" in p else textwrap.fill(p, 66) for p in text.split("\n\n"))) for name, text in files.items()] + list(files.items())
    rows += [("notices", "Licensed under the MIT License.\nDistributed under GNU GPL v3\nReleased under the GPLv2\nThis project is licensed under the Apache License 2.0.\nunder the sun")]
    found = licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.doc_id for r in found if r.licence_id != (None if r.doc_id == "notices" else r.doc_id)] == []
    assert [r.notice_ids for r in found if r.doc_id == "notices"] == ["Apache-2.0,GPL-2.0,GPL-3.0,MIT"]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, texts, k):
    found = rows_of(near_duplicates(docs, shingle=k), "doc_id")
    want = brute.near_duplicates([x[:2] for x in texts], k)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in found.items()) and sum(i != x[1] for i, x in want.items()) > 5


def test_near_duplicates_in_a_dense_group(spark):
    """Variants of one text, many at 0.8 or close to it, so that stars around pivots leave components open."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    found = rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4), "doc_id")
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == brute.near_duplicates(rows, 4)


def test_near_duplicates_with_null_ids(spark):
    found = near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found) == [("3", "3", True), ("None", "3", False), ("None", "3", False), ("None", "None", False)]


def test_near_duplicates_with_negative_ids(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(-7, "a b c d e f"), (-5, "one two three four five"), (-4, "one two three four five"), (-9, long), (8, long + " x"), (-6, long + " y"), (3, "q r s t u v"), (-2, "q r s t u v"), (None, "q r s t u v"), (None, "k l m n o p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(docs).collect())
    want = [(-7, -7), (-5, -5), (-4, -5), (-9, -9), (8, -9), (-6, -9), (3, -2), (-2, -2), (None, -2), (None, None)]
    assert found == sorted((str(i), str(c), i is not None and i == c) for i, c in want)
    left = corpus_pipeline.near_dedup(spark, docs.where("doc_id is not null"), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [-9, -7, -5, -2]


@pytest.mark.parametrize("mus", [(300.0,), lm.MUS, (30.0, 9.0, 4.0), (30.0, 9.0, 4.0, 2.5)])
def test_language_model(docs, texts, mus, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4000)
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    found = rows_of(lm.score(docs, held_out=held, mus=mus), "doc_id")
    out = [zlib.crc32(str(x[0]).encode()) % 10 == 0 for x in texts]
    assert any(out)
    for x, h, want in zip(texts, out, brute.language_model([x[1] for x in texts], out, mus)[0]):
        r = found[x[0]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, *want[:3])
        assert (r.base_score, r.score) == pytest.approx(want[3:], rel=1e-9)


def _automaton(texts, mus, learned=None):
    lengths = np.array([len(t.encode()) for t in texts])
    grams = lm.Grams("".join(texts).encode(), lengths, 1 + len(mus), 64)
    learned = np.ones(len(texts), bool) if learned is None else learned
    asked = grams.asked(learned)
    return lm.Automaton(grams, [e for _, _, e in asked], [c.astype(np.uint64) for _, c, _ in asked], int(asked[0][1].sum()), int((asked[0][1] > 0).sum()), mus)


@pytest.mark.parametrize("mus", [(30.0,), (30.0, 9.0, 4.0)])
def test_all_that_follows_a_state_sums_to_one(texts, mus):
    """Arcs of a state, and by its failure arc those of the shorter history, with the unknown token at the end."""
    a = _automaton([t for _, t, *_ in texts[:40]], mus)
    arcs = {}
    for m in range(len(mus) + 1):
        for place in np.flatnonzero(a.arc[m] >= 0).tolist():
            history = 0 if m == 0 else a.start if a.grams.place[place] == 0 else a.arc[m - 1][place - 1]
            arcs[m, int(history), int(a.grams.keys[0][place])] = a.weight[m][a.arc[m][place]]
    words = {w for m, _, w in arcs if m == 0}

    def p(m, state, word):
        if (m, state, word) in arcs:
            return 10 ** arcs[m, state, word]
        return a.unknown if m == 0 else 10 ** a.fails[m - 1][state] * p(m - 1, int(a.to[m - 1][state]), word)

    for m in range(len(mus) + 1):
        states = {s for k, s, _ in arcs if k == m}
        for state in sorted(states)[:25]:
            assert sum(p(m, state, w) for w in [*words, None]) == pytest.approx(1, abs=1e-9)


def test_pieces_of_a_long_text_are_read_as_a_whole(texts, monkeypatch):
    known = [t or "" for _, t, *_ in texts]
    whole = _automaton(known, lm.MUS).read()
    for size in (1, 2, 7):
        monkeypatch.setattr(lm, "PIECE", size)
        assert _automaton(known, lm.MUS).read() == pytest.approx(whole, rel=1e-12)


def test_language_model_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    total = lambda mus: lm.score(docs, held_out=held, mus=mus).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    two, three = total(lm.MUS[:1]), total(lm.MUS)
    assert three[0] > two[0] > two[1]


def test_token_counts(docs, texts):
    found = rows_of(token_counts.token_counts(docs), "doc_id")
    tok = brute.tokenizer()
    assert {k: (r.n_bytes, r.n_tokens) for k, r in found.items()} == {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in texts}


PAGE = """<!doctype html><html><head><title>T</title><style>p {}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h2>A heading &amp; more</h2><p>The first paragraph   of the article, long enough to be read as prose.</p><script>var x = "<p>no</p>";</script>
<div class="ad">Buy now!</div><p>The second <b>paragraph</b>&nbsp;ends here, after quite a few more words than the first.</p></article></main><aside class=sidebar><p>Popular: nothing at all.</p></aside>
<section id="comments"><p>A reader says that this article is the best one they have read in years.</p></section><form><label>Mail</label><input></form><footer>Copyright</footer></body></html>"""


def test_html(spark):
    article = "A heading & more The first paragraph of the article, long enough to be read as prose. The second paragraph ends here, after quite a few more words than the first."
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "u", "<p>"), (5, "u", "<div>" * 3000 + "deep" + "<article><p>" + "word " * 20_000), (1, "u", PAGE)]
    found = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    got = sorted(((str(r.page_id), r.text) for r in found), key=lambda x: x[0])
    assert [x[0] for x in got] == ["1", "1", "2", "3", "5", "None"]
    assert got[0][1] == got[1][1] == article and got[2][1] == got[3][1] == got[5][1] == ""
    assert got[4][1].count("word") == 20_000
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_min_cut_is_the_smallest_of_all_cuts():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 9)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda on: sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, on)) + sum(w for a, b, w in edges if on[a] != on[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.min_cut(scores, edges)) == pytest.approx(best, abs=0.02)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    x = np.concatenate((base, base[:30] + rng.normal(size=(30, 24)) * 0.3, base[:20], base[:1] + rng.normal(size=(60, 24)) * 0.4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23), (904, [float("nan")] + [1.0] * 23), (905, [float("inf")] + [1.0] * 23), (906, [1.0, 2.0])]
    found = rows_of(near_duplicate_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "e", "dim", "cls", "list", "body")})), "vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    root, links = brute.components(range(len(x)), zip(a.tolist(), b.tolist())), np.bincount(np.append(a, b), minlength=len(x))
    assert {i: (r.n_links, r.component_id) for i, r in found.items()} == {i: (links[i], root[i]) for i in range(len(x))} | {i: (0, i) for i, _ in odd}
    assert links.max() > 20 and all(r.kept == (i == r.component_id) for i, r in found.items())


@pytest.mark.parametrize("rank", [6, None])
def test_vectors_that_are_spread_in_few_directions(spark, rank):
    """Of low rank, or with a spectrum that decays: every link is found."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, rank)) @ rng.normal(size=(rank, 64)) if rank else rng.normal(size=(1500, 256)) / np.arange(1, 257)
    found = rows_of(near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")), "vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    root, links = brute.components(range(len(x)), zip(a.tolist(), b.tolist())), np.bincount(np.append(a, b), minlength=len(x))
    assert len(a) > 1000 and {i: (r.n_links, r.component_id) for i, r in found.items()} == {i: (links[i], root[i]) for i in range(len(x))}


def test_vectors_of_other_lengths_and_sizes(spark):
    """Each length by itself, also where two share an index, and components whose squares overflow or vanish."""
    rng = np.random.default_rng(3)
    rows = [[1.0, 1.0], [1.0, 1.0], [1.0, 1.01], [1e200, 0, 0], [1e200, 0, 0], [9e199, 1e198, 0], [1e-200, 1e-200, 0], [3e-200, 3e-200, 0], [5e-324, 5e-324, 0], [1.0, 1.0, 0.0], [1.0, 1.0, 0.0, 0.0], [1.0], [-2.0], [3.0]]
    for dim in (5, 6, 7, 8, 33):
        base = rng.normal(size=(30, dim))
        rows += [*base.tolist(), *(base[:20] + 0.2 * rng.normal(size=(20, dim))).tolist()]
    found = rows_of(near_duplicate_vectors(spark.createDataFrame(list(enumerate([float(c) for c in r] for r in rows)), "vec_id long, embedding array<double>")), "vec_id")
    links = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if len(rows[a]) == len(rows[b]):
                x, y = (np.array(v) / np.abs(v).max() for v in (rows[a], rows[b]))
                if x @ y >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y):
                    links.append((a, b))
    n = np.bincount(np.array(links).reshape(-1), minlength=len(rows))
    root = brute.components(range(len(rows)), links)
    assert {i: (r.n_links, r.component_id) for i, r in found.items()} == {i: (n[i], root[i]) for i in range(len(rows))}


def test_vectors_recall_where_few_lists_are_probed(spark):
    """In most data a measured width probes few lists; of all links against brute force, nearly all are found."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(3000, 64))
    x = np.concatenate((base, base[:1500] + rng.normal(size=(1500, 64)) * rng.uniform(0.05, 0.5, size=(1500, 1))))
    found = near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = int((u @ u.T >= 0.9).sum()) - len(x)
    got = found.agg(F.sum("n_links")).first()[0]
    assert want > 2000 and 0.99 * want <= got <= want


def test_vectors_of_nulls_and_nothing(spark):
    kind = "vec_id long, embedding array<float>"
    assert near_duplicate_vectors(spark.createDataFrame([], kind)).count() == 0
    found = near_duplicate_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (None, None)], kind)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in found) == [("2", 1, "2", True), ("None", 0, "None", False), ("None", 1, "2", False)]


def test_mixing(docs, texts):
    found = rows_of(mixing.mix(docs), "doc_id")
    want = brute.mixing([(i, t, s) for i, t, _, s, _ in texts])
    assert {k: (r["size"], r.source_size, r.target, r.taken) for k, r in found.items()} == want
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    assert {r.doc_id: r["count"] for r in whole.groupBy("doc_id").count().collect()} == {k: r.copies for k, r in found.items() if r.copies}
    assert all(r.taken <= 3 * r["size"] for r in found.values())


def test_mixing_of_many_sources(spark):
    """Sources whose limits are reached in several rounds, some without words, in code point order over partitions."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice((0, 1, 3, 50, 400)), rng.choice((None, "", *(chr(0x61 + k % 26) * (1 + k // 26) + "é" * (k % 2) for k in range(150))))) for i in range(600)]
    found = rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)), "doc_id")
    assert {k: (r["size"], r.source_size, r.target, r.taken) for k, r in found.items()} == brute.mixing(rows)


def test_languages(docs, texts):
    held = [zlib.crc32(str(x[0]).encode()) % 4 == 2 for x in texts]
    found = rows_of(lang_id.identify(docs, lang_id.profiles(docs.where(~lang_id.is_held_out()))), "doc_id")
    want = brute.languages([x[1] for x in texts], [(x[1], x[2]) for x, h in zip(texts, held) if not h])
    for x, (name, score) in zip(texts, want):
        assert found[x[0]].lang_pred == name and found[x[0]].score == pytest.approx(score, abs=1e-12)


def test_languages_of_held_out_documents(spark):
    found = queries.op10_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = found.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[1] > 100 and r[0] > 0.95


def test_pipeline(spark, texts, items, tmp_path):
    spark.createDataFrame(texts, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    items.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    named = brute.languages([x[1] for x in texts], [(x[1], x[2]) for x in texts])
    left = [x for x, (name, score) in zip(texts, named) if name != "und" and score >= 0.2]
    near = brute.near_duplicates([x[:2] for x in left], 5)
    left = [x for x in left if near[x[0]][1] == x[0]]
    hits = brute.winnowing([x[:2] for x in left], [(r.item_id, r.text) for r in items.collect()])
    left = [x for x in left if not hits[x[0]][1]]
    taken = brute.mixing([(i, t, s) for i, t, _, s, _ in left])
    mixed = [x[:2] for x in left for _ in range(round(taken[x[0]][3] / max(1, taken[x[0]][0])))]
    assert 10 < len(left) < len(texts) - 20
    assert got == sorted(brute.token_rows(mixed))


def test_tables_are_never_written_to_a_machine_of_a_cluster():
    from types import SimpleNamespace as N

    from candlework.llm._store import shared_folder

    def session(master, folder=None):
        return N(conf=N(get=lambda key, default: folder), sparkContext=N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))))

    with pytest.raises(ValueError):
        shared_folder(session("spark://somewhere:7077"))
    assert shared_folder(session("spark://somewhere:7077", "hdfs://x/y/")) == "hdfs://x/y"


def test_written_tables_can_be_deleted(spark, tmp_path):
    from candlework.llm import _store

    kept = _store.Scratch(spark, "some").keep(spark.range(3), "t")
    assert kept.count() == 3
    folder = Path(_store.shared_folder(spark).removeprefix("file:")) / "candlework"
    assert list(folder.glob("some-*/t"))
    _store.clear(spark)
    assert not folder.exists()


def test_pipeline_is_registered_with_five_stages(spark):
    import __spark_entry__

    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "token_output"]
    names = __spark_entry__.queries()
    assert sum(k.startswith("op") for k in names) == 10 and "pipeline" in names and Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


@pytest.mark.parametrize("name", ["op1_winnowing", "op4_near_duplicates", "op8_near_vectors", "op9_mixing"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    import __spark_entry__

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    mine = __spark_entry__.queries()[name](spark, folder)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(mine.columns)
    assert sorted(tuple(r) for r in mine.select(*columns).collect()) == sorted(cursor.fetchall())


def test_pipeline_stages_with_null_shared_and_repeated_ids(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "web"), (1, long, "web"), (None, long + " x", "web"), (None, "one of its own kind of text", "web"), (None, "one of its own kind of text", "web"), (2, "the same id but a clean text", "web"), (2, "a b c d e f g h i j k l", None), (None, "x a b c d e f g h i j y", None), (3, None, "web"), (3, "", "web"), (3, "", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in ("_gone", "_mix_of", "_mix_copy", "key_0", "key_1", "doc", "of", "rate", "kept", "id", "_metadata")})
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = lambda frame: sorted((str(r.doc_id), r.text) for r in frame.collect())
    for some in (docs, spark.read.parquet(f"{tmp_path}/documents.parquet")):
        some = some if some is not docs else docs.drop("_metadata")
        left = corpus_pipeline.near_dedup(spark, some, str(tmp_path))
        assert left.columns == some.columns
        assert texts(left.where("text is not null and text <> ''")) == sorted([("1", long), ("None", rows[3][1]), ("2", rows[5][1]), ("2", rows[6][1]), ("None", rows[7][1])])
        assert left.where("text is null or text = ''").count() == 3
        clean = corpus_pipeline.decontamination(spark, some, str(tmp_path))
        assert clean.columns == some.columns and texts(clean.where("text is not null")) == sorted((str(a), b) for a, b, _ in rows if b is not None and "a b c" not in b)
        mixed = corpus_pipeline.mixing_sources(spark, some, str(tmp_path))
        assert mixed.columns == some.columns and {r["_mix_copy"] for r in mixed.collect()} == {"_mix_copy"}


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_variants_that_are_not_linked(spark):
    """Many texts with differences from one original that link few of them, some to each other only."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    far = [f"v{i}" if i % 9 == 0 else w for i, w in enumerate(base)]
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        words = list(far if i % 3 == 0 else base)
        for _ in range(rng.randrange(2, 9)):
            words[rng.randrange(100)] = f"x{i}y{rng.randrange(5)}" if i % 2 else f"z{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    found = rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2), "doc_id")
    want = brute.near_duplicates(rows, 2)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == want
    assert len({c for _, c in want.values()}) > 20 and sum(i != c for i, (_, c) in want.items()) > 60


def test_near_duplicates_lose_few_links_to_banding(spark):
    """At two bands of six rows many pairs share no band; none may be lost that does."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(f"x{i}y{j}" if rng.random() < 0.05 else w for j, w in enumerate(base))) for i in range(120)]
    found = rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1), "doc_id")
    assert {i: r.component_id for i, r in found.items()} == {i: c for i, (_, c) in brute.near_duplicates(rows, 1).items()}
