import random

import numpy as np
import pytest
import sentencepiece

import __spark_entry__
from tracequarry.llm.pieces import MARK, MODEL, Decoder, Encoder, decode_ids, encode_texts, read_model, vocabulary

DATA = open(MODEL, "rb").read()


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def as_unigram(data):
    """The same pieces as a file of unigram kind: field 3 of the trainer's settings becomes 1."""
    at, out = 0, b""
    while at < len(data):
        size = shift = 0
        start, key = at, data[at]
        at += 1
        while True:
            size |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                break
        body, at = data[at : at + size], at + size
        if key >> 3 == 2:
            body = body.replace(b"\x18\x02", b"\x18\x01", 1) if b"\x18\x02" in body else body
            out += bytes([key]) + varint(len(body)) + body
        else:
            out += data[start:at]
    return out


def odd_texts(n=2000):
    rng = random.Random(1)
    pieces = [p.replace(MARK, " ") for p in vocabulary(DATA).ids]
    found = ["".join(rng.choice(f" {MARK}  abcdéß\n\t012<>/s😀€中文字はﬁ") for _ in range(rng.randrange(40))) for _ in range(n)]
    found += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    return [*found, *(" " * k for k in range(40)), *("a" * k for k in range(40)), *("x" + " " * k + "y" for k in range(40)), "<s> [INST] </s>", "<0x41>", "\x00\r\n"]


def ids_of(encoder, texts):
    return [np.frombuffer(ids, np.int32).tolist() for ids in encoder.encode(texts)]


def test_every_document_as_the_library_encodes_it(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = __spark_entry__.queries()["op2_sentencepiece"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want) and r.n_byte_tokens == sum(3 <= i < 259 for i in want)
        assert r.lossless == (library.decode(want) == texts[r.doc_id])


def test_odd_texts_by_merges():
    library, vocab, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), vocabulary(DATA), odd_texts()
    found = ids_of(Encoder(vocab), texts)
    assert found == library.encode(texts)
    assert [Decoder(vocab).decode(x) for x in found] == library.decode(found)


def test_words_of_many_portions_are_looked_for_once(monkeypatch):
    """Words that several portions hold stay known, and a step between nodes is looked up in the pieces' parts once."""
    texts = [" ".join(f"{k * 2654435761 % 10**9:x}" for k in range(at, at + 50_000)) for at in range(0, 150_000, 50_000)]
    encoder, learned, steps = Encoder(vocabulary(DATA)), [], []
    learn, step = encoder.learn, encoder.step
    monkeypatch.setattr(encoder, "learn", lambda words: (learned.append(len(words)), learn(words)))
    monkeypatch.setattr(encoder, "step", lambda node, character: (steps.append((node.text, character)), step(node, character))[1])
    for _ in range(2):
        for text in texts:
            list(encoder.encode([text]))
    assert learned[:3] == [50_000] * 3 and sum(learned[3:]) == 0
    assert len(steps) == len(set(steps)) < 100_000


def test_few_steps_and_pairs_remembered(monkeypatch):
    library, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), odd_texts(200)
    monkeypatch.setattr("tracequarry.llm.pieces.STEPS", 7)
    monkeypatch.setattr("tracequarry.llm.pieces.PAIRS", 5)
    assert ids_of(Encoder(vocabulary(DATA)), texts) == library.encode(texts)


def test_best_sums_by_unigram_scores():
    """Against all segmentations of short words."""
    vocab = vocabulary(as_unigram(DATA))
    assert not vocab.merges
    encoder, rng = Encoder(vocab), random.Random(2)
    strange = next(chr(k) for k in range(0x1F300, 0x1FAFF) if chr(k) not in vocab.ids)

    def best(word):
        found = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = [(found[s][0] + vocab.scores[vocab.ids[word[s:end]]], [*found[s][1], word[s:end]]) for s in range(end) if word[s:end] in vocab.ids]
            if word[end - 1] not in vocab.ids:
                options.append((found[end - 1][0] + vocab.worst, [*found[end - 1][1], word[end - 1]]))
            found.append(max(options, key=lambda x: x[0]))
        return found[-1][0]

    words = {MARK + "".join(rng.choice(f"theraingo{strange}") for _ in range(rng.randrange(1, 12))) for _ in range(500)}
    encoder.learn(words)
    for word in words:
        ids = np.frombuffer(encoder.words[word], np.int32).tolist()
        total = sum(vocab.scores[i] for i in ids if not 3 <= i < 259) + vocab.worst * word.count(strange)
        assert total == pytest.approx(best(word))
        assert Decoder(vocab).decode(ids) == word[1:]


def test_odd_rows(spark):
    model = read_model(spark)
    rows = [(1, None, 5), (2, "", None), (None, "no id", 6), (3, "same", 7), (3, "same", 7), (4, f"mark {MARK} here", 8), (5, "word " * 200_000, 9), (6, "x" * 300_000, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    found = encode_texts(frame, model)
    assert found.columns == ["doc_id", "text", "ids"] and dict(found.dtypes)["ids"] == "array<int>"
    got = {r.doc_id: r for r in decode_ids(found, model).collect()}
    assert found.count() == len(rows) and got[1].ids == [] and got[2].ids == [] and got[1].decoded == ""
    assert all(got[k].decoded == got[k].text for k in (2, 3, 5, 6, None)) and got[4].decoded == "mark   here"
    assert encode_texts(frame.limit(0), model).count() == 0


def test_clashing_names_in_either_case(spark, tmp_path):
    model = read_model(spark)
    frame = spark.createDataFrame([(1, "some text", 5, "old")], "doc_id long, text string, IDS int, Decoded string")
    found = decode_ids(encode_texts(frame, model), model)
    assert found.columns == ["doc_id", "text", "ids", "decoded"] and found.first().decoded == "some text"
    found.write.parquet(str(tmp_path / "out"))
    odd = spark.createDataFrame([(None,), ([],), ([-1, 10**6, None],)], "ids array<int>")
    assert [r.decoded for r in decode_ids(odd, model).collect()] == [None, "", ""]
