"""The pipeline's stages against brute force, each on its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from test_line_dedup import plain as plain_lines
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline as P
from docdrift.llm import line_dedup, packing, toxicity

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash", "packing"]

    kept = P.toxicity_stage(llm, docs, SF)
    assert kept.columns == columns
    model = toxicity.train(docs, llm.read.parquet(f"{SF}/labels.parquet"))
    score = {i: sum(model.weights.get(w, 0) for w in toxicity.terms_of(r.text)) for i, r in by_id(docs).items()}
    assert set(by_id(kept)) == {i for i, s in score.items() if s < model.thresholds[0]}

    lines = P.line_dedup_stage(llm, kept, SF)
    assert lines.columns == columns
    rows = [(r.doc_id, r.source, r.text) for r in kept.collect()]
    expected = {i: t for i, _, t, _, _ in plain_lines(rows, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)}
    assert {i: (r.text, r.n_chars) for i, r in by_id(lines).items()} == {i: (t, len(t)) for i, t in expected.items()}

    single = P.simhash_stage(llm, lines, SF)
    assert single.columns == columns
    texts = {i: r.text for i, r in by_id(lines).items()}
    ids = sorted(texts)
    groups = plain_components([plain_fingerprint(texts[i]) for i in ids], ids, 3)
    assert set(by_id(single)) == set(groups)

    pieces = P.packing_stage(llm, single, SF).collect()
    library = Tokenizer.from_file(packing.byte_bpe_path())
    found, places = defaultdict(list), defaultdict(list)
    for r in pieces:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(found) == set(by_id(single))
    for i, own in found.items():
        tokens = library.encode(texts[i], add_special_tokens=False).ids + [2]
        assert sum(x[2] for x in own) == len(tokens)
        for _, start, length, crc in own:
            assert crc == zlib.crc32(np.array(tokens[start : start + length], "<u4").tobytes())
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    run = P.run(llm, SF).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in run) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


def test_stages_on_odd_documents(llm):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d", None, "s", 7), (5, "a b c d", "en", None, 7)]
    empty = llm.createDataFrame([], schema)
    docs = llm.createDataFrame(rows, schema)
    for name, stage in P.STAGES:
        assert stage(llm, empty, SF).collect() == [], name
    lines = P.line_dedup_stage(llm, P.toxicity_stage(llm, docs, SF), SF)
    assert lines.count() == 5
    kept = P.simhash_stage(llm, lines, SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 5]
    assert len(P.packing_stage(llm, lines, SF).collect()) == 5


def test_toxic_documents_are_rejected(llm):
    docs, labels = (llm.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    rejected = set(by_id(docs)) - set(by_id(P.toxicity_stage(llm, docs, SF)))
    assert len(rejected & toxic) >= len(toxic) // 2
    assert not rejected & {r.doc_id for r in labels.where("toxic = 0").collect()}


def test_a_group_of_copies_keeps_its_text(llm):
    copied = {g: "\n".join(f"{g} copied line {k} of text {k * k}" for k in range(6)) for g in ("first", "second")}
    rows = [(i, f"menu of the site\nown words {i} {i * i} of page {i**3}", "en", "s", 0) for i in range(60)]
    rows += [(100 + i, "menu of the site\n" + copied["first"], "en", "s", 0) for i in range(30)]
    rows += [(200 + i, copied["second"], "en", "t", 0) for i in range(10)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    for _, stage in P.STAGES[:3]:
        docs = stage(llm, docs, SF)
    kept = [r.text for r in docs.collect()]
    assert kept.count(copied["first"]) == 1 and kept.count(copied["second"]) == 1
    assert "" not in kept and not any("menu" in t for t in kept)
    pieces = P.packing_stage(llm, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
