import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import licences
from tidewatch.llm.pieces import MARK, Pieces, checksum, crc_of, decode_ids, encode_texts, load_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "hello world", "  two  spaces ", "tab\tand\nlines\n\n", "naïve café 東京 \U0001f600 \x00", "x" * 3000, "aaaaaaaaab" * 40, "a" + MARK + "b", "The quick, brown fox's 12345.678 jumps; <s> </s> <0x0A>"]


@pytest.fixture(scope="module")
def pieces():
    return load_pieces(MODEL, "bpe")


def test_encodes_like_the_library_and_round_trips(spark, pieces):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeé tion the ing\n  .") for _ in range(rng.randrange(1, 400))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, ids string")
    shared = spark.sparkContext.broadcast(pieces)
    encoded = checksum(encode_texts(docs, shared))
    rows = {r["doc_id"]: r for r in decode_ids(encoded.drop("text"), shared).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, text in enumerate(texts):
        want = model.encode(text)
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == want, text
        assert rows[i]["n_ids"] == len(want) and rows[i]["ids_crc32"] == crc_of(want)
        assert rows[i]["text"] == text.replace(MARK, " ")
    assert rows[len(texts)]["n_ids"] == 0
    assert encode_texts(docs.limit(0), shared).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc" + MARK, min_size=1, max_size=8), min_size=1, max_size=12))
def test_unigram_words_have_the_best_score(words):
    rng = random.Random(3)
    vocab = ["".join(p) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)] + [MARK, MARK + "a", MARK + "ab"]
    table = Pieces([(0, "<unk>", 0.0, "unknown"), *((i + 1, p, -rng.uniform(1, 9) * 1.01, "normal") for i, p in enumerate(vocab))], "unigram")
    score = lambda parts: sum(table.scores.get(p, table.floor) for p in parts)
    for word, packed in zip(words, table.words(words), strict=True):
        ids = np.frombuffer(packed, np.uint32)
        cuts = (sorted(c) for n in range(len(word)) for c in itertools.combinations(range(1, len(word)), n))
        splits = ([word[a:b] for a, b in zip([0, *c], [*c, len(word)], strict=True)] for c in cuts)
        best = max((s for s in splits if all(p in table.ids or len(p) == 1 for p in s)), key=score)
        want = [k for k, _ in itertools.groupby((table.ids.get(p, 0) for p in best), key=lambda i: i or "u")]
        got = [k for k, _ in itertools.groupby(ids.tolist(), key=lambda i: i or "u")]
        names = {i: p for p, i in table.ids.items()}
        if 0 not in ids:
            assert abs(score([names[i] for i in ids.tolist()]) - score(best)) < 1e-9
        else:
            assert (0 in ids) == ("u" in want) and len(got) > 0


def test_licence_lines_are_found_and_prose_is_left_alone(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("river stone light morning paper house garden winter under the of a to in with any person public work terms source".split())
    prose = lambda: "\n".join(" ".join(word() for _ in range(rng.randrange(4, 30))).capitalize() + "." for _ in range(6))
    planted = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 2.", "cc-by-nc": "Licensed under CC BY-NC 3.0.", "apache": "Licensed under the Apache License, Version 2.0."}
    rows = [(i, prose(), None) for i in range(60)]
    kinds = list(planted)
    for i in range(60, 120):
        text = prose().split("\n")
        text.insert(rng.randrange(len(text) + 1), planted[kinds[i % 4]])
        rows.append((i, "é\n" + "\n".join(text), kinds[i % 4]))
    rows += [(200, None, None), (201, "", None), (201, "", None), (None, planted["mit"], "mit")]
    docs = spark.createDataFrame([(i, t, "zz") for i, t, _ in rows], "doc_id long, text string, families string")
    out = licences.scan_licences(docs, background=50).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    for i, text, family in rows:
        assert got[i]["families"] == (family or ""), (i, text)
        for span in got[i]["licences"]:
            if span["family"] == family:
                assert text[span["start"] : span["end"]] == (planted[family] if i is None else next(x for x in text.split("\n") if x[:8] == planted[family][:8]))
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_held_out_accuracy_of_the_classifier():
    model = licences.train([], seed=7)
    rows = licences.training_paragraphs([], 10, seed=99)
    right = 0
    for name, text in rows:
        blob = np.frombuffer(text.encode(), np.uint8)
        _, _, _, line, feature = licences.paragraph_features(blob, np.array([0, len(blob)]), licences.WordHasher())
        lines, z = model.logits(1, line, feature)
        right += len(lines) > 0 and model.classes[int(z[0].argmax())] == name
    assert right / len(rows) > 0.9


WRAPPED = {
    "gpl": """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. */""",
    "mit": """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction""",
    "apache": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "agpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation""",
}


def test_wrapped_notices_are_paragraphs(spark):
    prose = "The river ran under the stone house in the morning.\nA garden in winter light."
    rows = [(i, f"{prose}\n\n{text}\n\n{prose}", family) for i, (family, text) in enumerate(WRAPPED.items())]
    rows += [(10, "GNU GENERAL PUBLIC LICENSE Version 2", "gpl"), (11, "x = 1\n# SPDX-License-Identifier: MIT\ny = 2", "mit")]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, family string"), background=50).collect()}
    for i, text, family in rows:
        assert got[i].families == family, (got[i], text)
        if i < 10:
            span = got[i].licences[0]
            assert text[span.start : span.end].count("\n") >= 1


def test_unlisted_licences_are_unknown(spark):
    """Families held out of training are licence-like, but none of the families."""
    held_out = ["This program is licensed under the Eclipse Public License, version 2.0.", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the European Union Public Licence, version 1.2."]
    out = licences.scan_licences(spark.createDataFrame(list(enumerate(held_out)), "doc_id long, text string"), background=10).collect()
    assert all(r.families == "" for r in out) and sum(r.n_unknown for r in out) >= 2
