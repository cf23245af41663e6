"""Problems 1, 3, 4 and 8: noise, look-alikes, truncation and garbling on made texts."""

import random
import re
from collections import Counter

import pytest

from quillframe.llm import canon, garbled, noise, scan_noise, truncation
from quillframe.llm.boost import Boosted

LINE = "instance_id string, engine string, page_number int, source_order int, block_id string, text string, confidence double, kind string, section int, word string"
BLOCK = "instance_id string, engine string, block_id string, text string, page_numbers array<int>, word string"
RESULT = "instance_id string, name string, model_index int, status string, raw_output string, raw_output_bytes long, text string"
DOC = "doc_id long, source string, text string, swap int, runs string"

NOUNS = ["harbour", "wagons", "barrels", "warehouse", "cartons", "gravel", "lumber", "copper", "timber", "sulphur", "furnace", "laboratory"]
VERBS = ["carries", "delivers", "collects", "measures", "inspects", "records"]


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.randrange(10, 999)} {rng.choice(NOUNS)} during the {rng.choice(NOUNS)} inspection."


# --- problem 3 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ｔｗｅｌｖｅ １２", "Twelve 12"), ("co​pper﻿", "copper"), ("a b c　d", "a b c d"), ("révision", "révision"), ("ﬁsh oﬃce", "fish office"),
        ("part‑time", "part-time"), ("Еurо", "Euro"), ("각", "각"), ("so­ft", "soft"), ("e​́", "é"), ("й", "й"),
        ("Желтый склад", "Желтый склад"), ("m² ½ “x” – … λ = σ", "m² ½ “x” – … λ = σ"), ("plain", "plain"), ("", ""), ("cœur ß Å", "cœur ß Å"), ("日本語", "日本語"),
    ],
)
def test_rewrite(text, want):
    done = canon.transducer().rewrite(text)
    assert done == want
    assert canon.transducer().rewrite(done) == done


def test_mapping_has_no_conflicts_and_ends_in_form():
    table = canon.mapping()
    rewrite = canon.transducer().rewrite
    assert len(table) > 3_000
    assert all(rewrite(t) == t for t in set(table.values()))


def _canon_tables(spark):
    lines = [("i", "e", 1, 0, "b01", "Ｗide", None, "x", 9, "w"), ("i", "e", 1, 0, "b01", "Ｗide", None, "x", 9, "w"), ("i", "e", 1, 1, None, None, None, None, None, None), ("i", "e", 2, 0, "b01", "é plain", None, None, None, None), (None, "e", None, None, None, "a b", None, None, None, None)]
    blocks = [("i", "e", "b01", "x" * 100_000 + "​", [1], "w"), ("i", "e", "b02", "", [1], "w"), ("i", "e", "b03", None, None, None)]
    return spark.createDataFrame(lines, LINE), spark.createDataFrame(blocks, BLOCK)


def test_odd_items(spark):
    found = {(r.table_name, r.instance_id, r.item) for r in canon.odd_items(*_canon_tables(spark)).collect()}
    assert found == {("ocr_lines", "i", "1:0"), ("ocr_lines", None, ""), ("ocr_blocks", "i", "b01")}
    texts = {(r.table_name, r.item): r.text for r in canon.canonical_items(*_canon_tables(spark)).collect()}
    assert texts["ocr_lines", "1:0"] == "Wide" and texts["ocr_blocks", "b02"] == "" and texts["ocr_lines", "2:0"] == "é plain"


def test_canon_of_empty_tables(spark):
    lines, blocks = (df.where("1 = 0") for df in _canon_tables(spark))
    assert canon.odd_items(lines, blocks).count() == 0
    assert canon.canonical_items(lines, blocks).count() == 0


# --- problem 4 --------------------------------------------------------------------------------------------------


def _truncation_tables(spark):
    rng = random.Random(4)
    whole = [(f"w{i}", "e", "b01", " ".join(sentence(rng) for _ in range(rng.randrange(1, 4))), [1], None) for i in range(300)]
    heads = [(f"h{i}", "e", "b02", f"Summary for {rng.choice(NOUNS)}", [1], None) for i in range(60)] + [(f"t{i}", "e", "b03", f"Total {rng.randrange(9999)}", [1], None) for i in range(40)]
    odd = [("n", "e", "b04", None, None, None), ("z", "e", "b05", "", None, None)]
    cut = [("c0", "e", "b01", "The harbour of the timber carries 20 barrels dur", [1], None), ("c1", "e", "b01", sentence(rng) + " The ware", [1], None), ("c2", "e", "b01", sentence(rng)[:-5] + "…", [1], None), ("c3", "f", "b01", "The copper of the lumber measures 3 wagons during the [..]", [1], None), ("c3", "f", "b01", "The copper of the lumber measures 3 wagons during the [..]", [1], None)]
    blocks = spark.createDataFrame(whole + heads + odd + cut, BLOCK)
    j = '{"blocks": [{"text": "The harbour."}]}'
    rows = [("r0", "m", 1, "ok", j, len(j), ""), ("r1", "m", 1, "ok", j[:-4], len(j) - 4, ""), ("r2", "m", 2, "ok", "<page><p>a.</p></page>", 22, ""), ("r3", "m", 2, "ok", "<page><p>a.</p>", 15, ""), ("r4", "n", 1, "ok", "b01: The harbour rests.\nb02: Total 12", 39, ""), ("r5", "n", 1, "ok", "b01: The harbour rests.", 400, ""), ("r6", "n", 1, "failed", "<page>", 6, ""), ("r7", "n", 1, "ok", None, None, ""), ("r8", "n", 1, "ok", "b01: The harbour rests. The lab", None, "")]
    return blocks, spark.createDataFrame(rows, RESULT)


def test_truncation(spark):
    blocks, results = _truncation_tables(spark)
    cases = truncation.judged(blocks, results)
    assert {r.instance_id for r in cases.collect()} == {"c0", "c1", "c2", "c3", "r1", "r3", "r5", "r8"}
    share = {(r.table_name, r.source): (r.n_texts, r.n_cut) for r in truncation.cut_share(blocks, results, cases).collect()}
    assert share["results", "m"] == (4, 2) and share["ocr_blocks", "f"] == (1, 1)


def test_truncation_of_empty_tables(spark):
    blocks, results = (df.where("1 = 0") for df in _truncation_tables(spark))
    assert truncation.judged(blocks, results).count() == 0


# --- problem 8 --------------------------------------------------------------------------------------------------


def _documents(spark):
    rng = random.Random(8)
    parts = ["Größere Mengen Äpfel wurden über die Straße geliefert.", "La compañía pidió más tubería para el día próximo.", "Le dépôt a reçu des pâtes à l'été.", "남은 고무관은 모두 다음 주에 보낸다.", "The price is 20 € – paid."]
    clean = [" ".join(rng.choice(parts) for _ in range(3)) for _ in range(400)]
    rows = [(i, "a", t, 0, "") for i, t in enumerate(clean)]
    swaps = [("utf-8", "cp1252"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("cp949", "latin-1"), ("utf-8", "cp1251")]
    hurt = {}
    for k in range(30):
        text = rng.choice(clean)
        written, read = swaps[k % len(swaps)]
        try:
            bad = text.encode(written).decode(read)
        except UnicodeError:
            continue
        if bad != text:
            hurt[1_000 + k] = text
            rows.append((1_000 + k, "b", bad, 0, ""))
    rows += [(2_000, "b", "The viewer showed “â€™” for a while.", 0, ""), (2_001, None, None, 0, ""), (2_002, "b", "", 0, ""), (2_003, "b", "┌────┐ Ångström", 0, ""), (2_004, "b", "The sign is marked � in the chart.", 0, ""), (2_005, "b", "Gr��ere Mengen �pfel", 0, ""), (2_006, "b", "x" * 200_000, 0, "")]
    return spark.createDataFrame(rows, DOC), hurt


def test_garbled(spark):
    documents, hurt = _documents(spark)
    found = {r.doc_id for r in garbled.garbled_documents(documents).collect()}
    assert found == set(hurt) | {2_005}
    restored = {r.doc_id: (r.text, r.restored) for r in garbled.restored_documents(documents).collect()}
    exact = sum(restored[k] == (t, True) for k, t in hurt.items())
    assert exact >= 0.9 * len(hurt)
    assert restored[2_005][1] is False
    swaps = {r.swap: r.n_documents for r in garbled.swaps_by_source(documents).collect() if r.source == "b"}
    assert swaps["lost"] == 1
    planted = Counter((k - 1_000) % 5 for k in hurt)
    assert swaps["cp1252>utf_8"] >= 0.9 * planted[0] and swaps["cp1251>utf_8"] >= 0.9 * planted[4]


@pytest.mark.parametrize("run,number", [(run, number) for run in ("Ã©", "Ã¤Ã¶", "â‚¬", "쨀", "é", "Ð¿Ñ€") for number, _ in garbled.readings(run)])
def test_units_make_up_a_reading(run, number):
    meant = dict(garbled.readings(run))[number]
    parts = garbled.units(run, meant, number)
    assert "".join(s for s, _ in parts) == run and "".join(t for _, t in parts) == meant


def test_garbled_of_an_empty_table(spark):
    documents, _ = _documents(spark)
    assert garbled.garbled_documents(documents.where("1 = 0")).count() == 0


# --- problem 1 --------------------------------------------------------------------------------------------------


def test_confusions():
    assert noise.confusions("tlat", "flat") == 1 and noise.confusions("kemels", "kernels") == 1 and noise.confusions("same", "same") == 0
    assert noise.confusions("thé", "the") is None
    assert noise.fold("Prüfiing") == noise.fold("Prüfung") and noise.fold("wareh0use") == noise.fold("warehouse")


@pytest.mark.parametrize("word,want", [("3l1", True), ("S37", True), ("20O96", True), ("123", False), ("1,234.5", False), ("b05", False), ("hours", False), ("Z", True), ("A", False)])
def test_number_misread(word, want):
    assert scan_noise.number_misread(word) is want


def test_boosted_trees_separate():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = Boosted().fit(x[:400], y[:400])
    assert ((model.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    assert Boosted().fit(np.zeros((0, 3)), np.zeros(0)).predict(x[:2]).shape == (2,)


def _scanned(spark):
    rng = random.Random(11)
    lines, blocks, truth = [], [], set()

    def page(doc, first, texts):
        for k, t in enumerate(texts):
            lines.append((doc, "e", first, k, None if k == 0 else "b01", t, None, None, None, None))

    for d in range(150):
        doc = f"d{d:03d}"
        words = " ".join(sentence(rng) for _ in range(6)).split()
        rows = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        head = f"{rng.choice(NOUNS).upper()} WORKING COPY"
        mid = len(rows) // 2
        page(doc, 1, [head, "b01: " + rows[0], *rows[1:mid], "Page 1 of 2"])
        page(doc, 2, [head, *rows[mid:], "Page 2 of 2"])
        truth |= {(doc, "1:0", "furniture"), (doc, f"1:{mid + 1}", "furniture"), (doc, "2:0", "furniture"), (doc, f"2:{len(rows) - mid + 1}", "furniture")}
        blocks.append((doc, "e", "b01", " ".join(rows), [1, 2], None))
    extra = [
        ("x", 0, "b01: The harbour of the wagons car-", "hyphen"), ("x", 1, "ries 20 barrels during the timber wareh0use", "misread"), ("x", 2, "inspection - timber - of the harboiir", "misread"),
        ("x", 3, "and the laboratory mea", "hyphen"), ("x", 4, "sures 3l2 cartons.", "misread"),
    ]
    for doc, k, text, kind in extra:
        lines.append((doc, "e", 1, k, "b01", text, None, None, None, None))
        truth.add((doc, f"1:{k}", kind))
    blocks.append(("x", "e", "b01", "The harbour of the wagons car- ries 20 barrels", [1], None))
    lines += [("n", "e", 1, 0, None, None, None, None, None, None), ("n", "e", 1, 1, None, "", None, None, None, None), ("x", "e", 1, 0, "b01", extra[0][2], None, None, None, None)]
    blocks += [("n", "e", "b01", None, None, None), ("n", "e", "b02", "", None, None)]
    return spark.createDataFrame(lines, LINE), spark.createDataFrame(blocks, BLOCK), truth


def test_scan_noise(spark):
    lines, blocks, truth = _scanned(spark)
    found = {(r.instance_id, r.item, r.kind) for r in scan_noise.noisy_items(lines, blocks).where("table_name = 'ocr_lines'").collect()}
    assert len(found & truth) >= 0.95 * len(truth)
    assert len(found - truth) <= 0.05 * len(truth)
    assert {t for t in truth if t[0] == "x"} <= found
    own = {(r.instance_id, r.item, r.kind) for r in scan_noise.noisy_items(lines, blocks).where("table_name = 'ocr_blocks'").collect()}
    assert ("x", "b01", "hyphen") in own


def test_a_misreading_at_the_top_of_a_page_is_found(spark):
    lines, blocks, _ = _scanned(spark)
    rows = [("y", "e", 1, 0, "b01", "b01: The harbour of the timber records 20 cartons", None, None, None, None), ("y", "e", 2, 0, "b01", "of the warehousc during the sulphur inspection", None, None, None, None)]
    found = scan_noise.noisy_items(lines.union(spark.createDataFrame(rows, LINE)), blocks.union(spark.createDataFrame([("y", "e", "b01", "of the warehousc", [1, 2], None)], BLOCK)))
    assert {(r.table_name, r.item, r.kind) for r in found.where("instance_id = 'y'").collect()} == {("ocr_lines", "2:0", "misread"), ("ocr_blocks", "b01", "misread")}


def test_broken_words_beyond_the_carried_lexicon_are_found(spark, monkeypatch):
    lines, blocks, _ = _scanned(spark)
    rows = []
    for k in range(6):
        rows += [("z", "e", 1, 2 * k, "b01", "the gravel moonlight of the copper", None, None, None, None), ("z", "e", 1, 2 * k + 1, "b01", "moon the furnace light the lumber", None, None, None, None)]
    rows += [("w", "e", 1, 0, "b01", "b01: The harbour of the moon", None, None, None, None), ("w", "e", 1, 1, "b01", "light carries 20 barrels.", None, None, None, None)]
    rows += [("v", "e", 1, k, "b01", "moonlight moonlight of the timber", None, None, None, None) for k in range(20)]
    lines = lines.union(spark.createDataFrame(rows, LINE))
    for carried in (100_000, 4):
        monkeypatch.setattr(scan_noise, "CARRIED", carried)
        found = {(r.instance_id, r.item) for r in scan_noise.noisy_items(lines, blocks).where("kind = 'hyphen' AND table_name = 'ocr_lines'").collect()}
        assert {("w", "1:0"), ("x", "1:0"), ("x", "1:3")} <= found


def test_repaired_blocks(spark):
    lines, blocks, _ = _scanned(spark)
    texts = {(r.instance_id, r.block_id): r.text for r in scan_noise.repaired_blocks(lines, blocks).collect()}
    assert texts["x", "b01"] == "The harbour of the wagons carries 20 barrels"
    assert texts["n", "b02"] == ""
    assert not any(re.search("WORKING COPY", t) for t in texts.values())


def test_scan_noise_of_empty_tables(spark):
    lines, blocks, _ = _scanned(spark)
    assert scan_noise.noisy_items(lines.where("1 = 0"), blocks.where("1 = 0")).count() == 0
    assert scan_noise.repaired_blocks(lines.where("1 = 0"), blocks.where("1 = 0")).count() == 0


def test_layout_of_a_wide_row_sees_its_end():
    wide = [x for k in range(9) for x in ("|", f"c{k}")] + ["|"]
    assert truncation.layout(wide) == truncation.layout([*wide[:-2], "other", "|"]) != ""
    assert len({truncation.layout(wide[:n]) for n in range(12, len(wide) + 1)}) == len(wide) - 11
    assert truncation.layout(["word"] * 20) == ""


def test_lengths_tell_cut_headings_and_abbreviations(spark):
    rng = random.Random(4)
    names = [f"{a} {b}" for a in ("stores", "goods", "timber", "copper") for b in ("north", "harbour", "east", "riverside")]
    whole = [f"Report {x} {y} station" for x in names for y in names]
    kept = [(f"w{i}", "e", "b01", t) for i, t in enumerate(whole)]
    # Running text shows the limit of 70 characters; headings cut there end in words that end headings.
    shown = [(f"r{i}", "e", "b01", f"It was {i}. Then {' '.join(rng.choice(names) for _ in range(9))}"[:70].rstrip().ljust(70, "s")) for i in range(30)]
    cuts = [(f"c{i}", "e", "b01", f"Report {'x' * (53 - i)} {'y' * (i + 1)} station") for i in range(9)]
    stop = [("s0", "e", "b01", "x" * 62 + " approx."), ("s1", "f", "b01", "x" * 62 + " approx."), ("s2", "e", "b01", "x" * 61 + " station.")]
    known = [(f"k{i}", "g", "b01", f"It took approximately {i} hours of work at the {rng.choice(names)} station.") for i in range(10)]
    assert {len(r[3]) for r in shown + cuts + stop[::2]} == {70}
    rows = kept + shown + cuts + stop + known
    found = {r.instance_id for r in truncation.judged(spark.createDataFrame(rows, "instance_id string, engine string, block_id string, text string"), _truncation_tables(spark)[1]).collect()}
    assert {r[0] for r in shown + cuts} | {"s0"} <= found
    assert not found & ({"s1", "s2"} | {r[0] for r in kept + known})


def test_every_length_limit_counts_however_many_there_are(spark):
    n, text = 4_100, "It was so. Then the goods of the station"
    rows = spark.range(n * 21).selectExpr("concat('i', id) AS instance_id", "concat('e', id % {0}) AS engine".format(n), "'b01' AS block_id", f"if(id < {n}, rpad('Report', {len(text)}, ' xx'), '{text}') AS text")
    cases = truncation.judged_by(rows, _truncation_tables(spark)[1]).where("table_name = 'ocr_blocks'")
    assert {(r.evidence, r["count"]) for r in cases.groupBy("evidence").count().collect()} == {("length limit", n * 21)}


def test_bigrams_are_counted_over_all_documents(spark, monkeypatch):
    seen, real = [], garbled.scored
    monkeypatch.setattr(garbled, "scored", lambda runs, counts: (seen.append(counts), real(runs, counts))[1])
    rows = [(1, "a", "qz caf\u00e9 qz"), (2, "a", "qz plain"), (2, "a", "qz plain"), (3, None, "qzqz"), (4, "b", ""), (5, "b", None), (None, "b", "qz")]
    garbled.garbled_runs(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    count = lambda b, x, y: min(b.rows[r][at] for r, at in enumerate(garbled._slot(ord(x), ord(y))))
    assert [(count(b, "q", "z"), count(b, "z", "q"), count(b, "p", "l")) for b in seen] == [(5, 1, 1)] * 2
    assert all(min(b.rows[r][at] for r, at in enumerate(garbled._slot(ord("q"), 0x1FFFFF))) == 5 for b in seen)


def test_candidates_of_short_and_long_words_are_exact(spark):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]

    long = "donaudampfschifffahrtsgesellschaftskapitaensmuetze"
    words = ["of", "on", "or", "at", "a", "is", "the", "tae", "tho", "cat", "cut", "ca", "word", "ward", "aaaa", "aaa", "k", long, long[:20] + "x" + long[21:]]
    rows = [(w, 100_000 if i % 2 == 0 else 1) for i, w in enumerate(words)]
    rows += [(w + "t", 1) for w in ("o", "c", "th")] + [("e" + long[1:], 1)]
    found = {(r.seen, r.meant) for r in scan_noise.candidate_pairs(spark.createDataFrame(rows, "word string, n long")).collect()}
    f = noise.fold
    assert found == {(a, b) for a, n in rows for b, m in rows if m >= scan_noise.RATIO * n and near(f(a), f(b))}
