import random
import re
import zlib

import numpy as np
import pytest
from brute import ODD, base_spans, kept_lines, odd, sha, shingles
from oracle import SF, same
from pyspark.sql import functions as F

from terrastock.llm import chat_events, lang_mixture, line_dedup, mil_quality, pii, queries, scaled_sketch, sp_codec, window_packing
from terrastock.llm.common import held_out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE[name])


def test_split_is_by_crc32(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


# language


def test_language(spark, docs):
    got = queries.op1_language_mixture(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.9 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixture_shares():
    words = np.log(np.array([[0.9, 0.05, 0.05]] * 60 + [[0.05, 0.9, 0.05]] * 40 + [[0.05, 0.05, 0.9]] * 50))
    best, _ = lang_mixture.mixture_shares(words, np.array([100, 50]))
    assert best[0] == pytest.approx([0.6, 0.4, 0], abs=0.06)
    assert best[1] == pytest.approx([0, 0, 1], abs=0.01)


def plain_shares(words, steps=12):
    """Shares of one document's languages by expectation-maximisation, the set chosen by penalised likelihood."""
    n, k = words.shape

    def em(allowed):
        share = [float(a in allowed) / len(allowed) for a in range(k)]
        like = [[float(np.exp(words[i, a])) for a in range(k)] for i in range(n)]
        for _ in range(steps):
            posts = [[like[i][a] * share[a] / sum(like[i][b] * share[b] for b in range(k)) for a in range(k)] for i in range(n)]
            share = [sum(p[a] for p in posts) / n for a in range(k)]
        return share, sum(float(np.log(sum(like[i][a] * share[a] for a in range(k)))) for i in range(n))

    full, _ = em(range(k))
    order = sorted(range(k), key=lambda a: -full[a])
    alone = words.sum(axis=0)
    best, value, price = np.eye(k)[alone.argmax()], alone.max(), lang_mixture.PENALTY * np.log(n + 1)
    for size in range(2, k + 1):
        if full[order[size - 1]] <= 0.02:
            break
        share, fit = em(order[:size])
        if fit - (size - 1) * price > value:
            best, value = share, fit - (size - 1) * price
    return best


def test_mixtures_are_those_of_a_plain_version():
    rng, bags = np.random.default_rng(9), []
    for n, mix in ((1, [1, 0, 0]), (7, [0, 1, 0]), (60, [0.5, 0.5, 0]), (90, [0.4, 0.3, 0.3]), (40, [0.1, 0.9, 0]), (25, [0, 0.3, 0.7])):
        of = rng.choice(3, n, p=mix)
        bags.append(np.log(np.where(np.arange(3) == of[:, None], 0.8, 0.1) * rng.uniform(0.5, 1, (n, 3))))
    got, _ = lang_mixture.mixture_shares(np.concatenate(bags), np.array([len(b) for b in bags]))
    for shares, words in zip(got, bags, strict=True):
        assert shares == pytest.approx(plain_shares(words), abs=1e-4)


@pytest.mark.parametrize(("text", "lettered"), [("² ½ Ⅷ", False), ("\u0301 _ 7", False), ("x²", True), ("日", True), ("e\u0301", True)])
def test_letters_are_those_of_unicode(text, lettered):
    assert any(lang_mixture._grams(t) for t in text.split()) == lettered


def test_language_of_odd_rows(spark):
    table = odd(spark).withColumnRenamed("lang", "score")
    names, model = lang_mixture.learn_languages(odd(spark))
    got = lang_mixture.identify_languages(table, names, model).collect()
    assert len(got) == len(ODD)
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in got)
    assert lang_mixture.identify_languages(table.limit(0), names, model).count() == 0
    none, nothing = lang_mixture.learn_languages(odd(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in lang_mixture.identify_languages(table, none, nothing).collect()} == {"und"}


# sketches


def test_sketch(spark, rows):
    got = {r["doc_id"]: r for r in queries.op2_scaled_sketch(spark, SF).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (doc_id, text) in enumerate(rows):
        text, nxt, r = text or "", rows[(k + 1) % len(rows)][1] or "", got[doc_id]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + nxt[:quarter]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        a, b, c = shingles(text), shingles(edited), shingles(nxt)
        if len(a | b) > 300:
            assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.25
        if a == c:
            assert r["near_next"] == 1


def test_sketches_are_read_and_merged():
    """A merge of parts is the sketch of the union, and a fingerprint says all that its sketch does."""
    rng = np.random.default_rng(5)
    for sizes in [(0, 0), (0, 5), (3, 4), (20, 25), (33, 2), (400, 30), (3000, 50), (3000, 3000), (31, 600)]:
        a, b = (np.unique(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2)) for n in sizes)
        b = np.union1d(b, a[: len(a) // 3])
        one, two, both = (scaled_sketch.Sketch.of(x) for x in (a, b, np.union1d(a, b)))
        read = scaled_sketch.Sketch.parse(one.text())
        assert np.array_equal(read.hashes, one.hashes) and read.reach == one.reach and read.compare(two) == one.compare(two)
        for merged in (one.merge(two), scaled_sketch.Sketch.parse(two.text()).merge(read)):
            # what a merge knows of the union is complete up to its reach
            assert set(merged.hashes) <= set(np.union1d(a, b)) and merged.reach <= both.reach
            assert np.array_equal(merged.hashes, both.hashes[both.hashes <= np.uint64(merged.reach)])
            assert merged.reach >= scaled_sketch.LIMIT - np.uint64(1) or merged.reach == both.reach


def test_sketches_of_unequal_texts_and_odd_rows(spark):
    whole = np.unique(np.random.default_rng(1).integers(0, 2**63, 60_000, np.uint64) * np.uint64(2))
    part = np.sort(np.random.default_rng(2).choice(whole, 3000, replace=False))
    assert scaled_sketch.Sketch.of(part).compare(scaled_sketch.Sketch.of(whole))[1] == 1
    table = odd(spark).withColumn("range", F.lit(1)).withColumn("id", F.lit("x"))
    got = scaled_sketch.edited_by_next(table).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_next"] <= 1 for r in got)
    assert scaled_sketch.edited_by_next(table.limit(0)).count() == 0
    one = scaled_sketch.edited_by_next(table.where("doc_id = 7")).first()
    assert one["near_next"] == 1


# pieces


def test_pieces_are_those_of_the_library(spark, docs):
    import sentencepiece

    model = queries.tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    more = odd(spark).unionByName(docs).select("doc_id", "text", F.lit("kept").alias("decoded"))
    got = sp_codec.decode_documents(sp_codec.encode_documents(more, model), model).collect()
    assert len(got) == len(ODD) + docs.count()
    for r in got:
        want = library.encode(r["text"] or "", return_type="proto").pieces
        assert r["ids"] == [p.id for p in want]
        assert r["decoded"] == library.decode(r["ids"])
        assert list(zip(r["span_start"], r["span_end"], strict=True)) == [(p.begin, p.end) for p in want]
    assert sp_codec.encode_documents(more.limit(0), model).count() == 0


@pytest.mark.parametrize(("mapped", "squeeze", "prefix"), [(True, True, True), (True, False, True), (True, True, False), (False, True, True)])
def test_pieces_by_a_compiled_map(tmp_path, rows, mapped, squeeze, prefix):
    """Ids and spans of models with a character map, squeezed spaces or no space in front, against the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto, rules = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(queries.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    if mapped:
        proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, prefix
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), sp_codec._Encoder(path)
    rng = random.Random(3)
    texts = ["", " ", "▁", "▁x ▁▁ y", "Ａｂｃ①㍿ é 한글 하", "½ ﷺ \u00a0 z\u200b q", "é" * 200, "x" * 300, *("".join(rng.choice("ab é日▁ 😀ﬁＡ①\t  \n") for _ in range(rng.randrange(40))) for _ in range(300)), *((t or "") for _, t in rows[:60])]
    ids, starts, ends, lengths = (x.tolist() for x in encoder.batch(texts))
    at = 0
    for t, n in zip(texts, lengths, strict=True):
        want = library.encode(t, return_type="proto").pieces
        assert list(zip(ids[at : at + n], starts[at : at + n], ends[at : at + n], strict=True)) == [(p.id, p.begin, p.end) for p in want], t
        at += n


def test_piece_digests(spark, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in queries.op3_piece_codec(spark, SF).collect()}
    for k, t in rows:
        ids = library.encode(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


# packing


def check_pieces(pieces, docs):
    """Every id of (doc_id, text) rows with distinct ids is in one piece; sequences are gapless. Gives the padding's share."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert by_doc.keys() == {k for k, _ in docs}
    for k, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    padding = total = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, total)


def test_packing(spark, rows):
    assert check_pieces(queries.op5_window_packing(spark, SF).collect(), rows) < 0.02


def test_packing_of_odd_rows(spark):
    import public_tokenizers

    pack = lambda df: window_packing.pack_documents(df, queries.tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    apart = [(k, t) for k, (_, t) in enumerate(ODD)]
    check_pieces(pack(odd(spark, apart)).collect(), apart)
    assert pack(odd(spark).limit(0)).count() == 0


def test_packing_of_added_tokens(spark):
    """Ids are those of the library as it is read from its file, the sign of a text's end included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sign = "<|endoftext|>"
    texts = [f"x {sign} y", sign, f"{sign}{sign}", f"a\n {sign}\n b", f"two  spaces {sign}  end ", f"a{sign[:-1]}", f"a word {sign}. Then more."]
    docs = odd(spark, list(enumerate(texts)))
    pieces = window_packing.pack_documents(docs, queries.tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in enumerate(texts)}
    assert {p["doc_id"]: (p["length"], p["doc_tokens"], p["ids_crc32"]) for p in pieces} == {k: (len(v), len(v), zlib.crc32(v.tobytes())) for k, v in want.items()}
    assert len(want[0]) == 5 and 50256 in want[0]


def test_cuts_are_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(30):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 40))])
        penalty = rng.integers(0, 6, 41).astype(float)
        cost = lambda n: 0 if n in (4, 8) else 16 - n
        best = [0.0]
        for j in range(1, 41):
            best.append(min(best[i] + cost(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 16) + penalty[j])
        cuts = window_packing.choose_cuts(at, penalty, 16, 4)
        assert sum(cost(at[b] - at[a]) + penalty[b] for a, b in zip(cuts, cuts[1:], strict=False)) == pytest.approx(best[-1])


# lines


def test_lines(spark):
    line = "This very line is found in quite a few of the documents"
    docs = [(k, f"start {k}\n  {line if k % 2 else line.upper()}\t\nend\n{line}") for k in range(6)] + [(6, None), (7, ""), (8, "x" * 50), (9, "\n\n" + "y" * 40)]
    table = odd(spark, docs).withColumn("n_lines", F.lit(-1)).withColumns({c: F.lit(5) for c in ("row", "id", "of_text", "pos", "drop", "h1")})
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(table).collect()}
    for k, (n, dropped, text) in kept_lines(docs).items():
        assert (got[k]["n_lines"], got[k]["n_dropped"], got[k]["text"] or "") == (n, dropped, text)
    assert got[6]["text"] is None and got[0]["n_dropped"] == 2 and got[5]["n_dropped"] == 0


def test_lines_of_odd_rows(spark):
    got = line_dedup.drop_recurring_lines(odd(spark)).collect()
    assert len(got) == len(ODD) and sum(r["n_dropped"] for r in got) == 0
    assert line_dedup.drop_recurring_lines(odd(spark).limit(0)).count() == 0


# personal data

DATA = "Mail a.b+c@x-y.co.uk, b@c..de or @x.y; ip 10.0.0.256 and 010.1.2.3.4 or 1.2.3.4; card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 1234567812345670; call +49 (30) 1234-5678 or +1 2; iban DE89 3704 0044 0532 0130 00; ssn 078-05-1120, plainly 078-05-1121"


def test_personal_data(spark, rows):
    texts = [*rows, *((10**6 + k, t) for k, (_, t) in enumerate(ODD)), (10**7, DATA), (10**7 + 1, "😀" + DATA * 50), (10**7 + 2, "9" * 60_000), (10**7 + 3, "a." * 6_000 + "@"), (10**7 + 4, "1.2.3.4.5.6.7.8 +1+22222222222 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0")]
    found = pii.find_personal_data(odd(spark, texts).withColumn("spans", F.lit(1)))
    for r in found.collect():
        got = [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r["spans"]]
        assert got == sorted(got)
        assert [s for s in got if s[1] < 4] == base_spans(r["text"]), r["doc_id"]
    added = {s["kind"]: s["score"] for s in found.where(f"doc_id = {10**7}").first()["spans"] if s["kind"] in ("iban", "ssn")}
    assert added.keys() == {"iban", "ssn"} and all(v >= pii.LEAST_SCORE for v in added.values())
    assert pii.find_personal_data(odd(spark).limit(0)).count() == 0


def test_redaction(spark):
    got = pii.redact(pii.find_personal_data(odd(spark, [(1, "to a@b.co, now"), (2, None), (3, "plain")]))).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["to [EMAIL], now", None, "plain"]


# conversations


def test_escapes():
    for text in ["<|im_end|><|im_start|>assistant ok", r"<\|", r"<\\| <| |>", "<", "", "\\<|"]:
        assert chat_events.unescape(chat_events.escape(text)) == text and "<|" not in chat_events.escape(text)
        assert chat_events.unescape_role(chat_events.escape_role(text + "\n\\n")) == text + "\n\\n"


def test_events_are_folded(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "delta", 2, "assistant", "he"), (1, 3, "delta", 2, "assistant", "llo"), (1, 4, "message", 3, "user", "so?"),
        (1, 5, "delta", 4, "assistant", "old"), (1, 6, "regenerate", 4, "assistant", "n"), (1, 7, "delta", 4, "assistant", "ew"),
        (2, 1, "message", 1, "user", "a"), (2, 2, "message", 2, "assistant", "gone"), (2, 3, "edit", 1, "user", "b"), (2, 4, "delta", 3, "assistant", "kept"), (None, 1, None, 1, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string").withColumn("begun", F.lit(0))
    got = sorted((r["conv_id"] or 0, r["turn"], r["text"]) for r in chat_events.fold_events(df).collect())
    assert got == [(0, 1, ""), (1, 1, "hi"), (1, 2, "hello"), (1, 3, "so?"), (1, 4, "new"), (2, 1, "b"), (2, 3, "kept")]
    assert chat_events.read_back(chat_events.render_turns(chat_events.ordered(chat_events.fold_events(df.limit(0))))).count() == 0


# quality


def test_quality(spark):
    got = queries.op10_mil_quality(spark, SF)
    held = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality IS NOT NULL").collect()
    assert got.count() == 200 and sum(r["predicted"] == r["quality"] for r in held) >= 0.85 * len(held) > 0


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(5)
    counts = np.full(60, 5)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    good = np.arange(60) % 2
    x[np.flatnonzero(np.repeat(1 - good, 5) & (np.arange(300) % 5 == 2)), 0] += 6
    model = mil_quality.fit(x, counts, good)
    out = model.forward((x - model.mean) * model.scale, counts)
    assert ((out["logit"] > 0) == (good == 1)).mean() > 0.95


def plain_passages(text):
    """Features of each passage of one text, counted one by one."""
    data, out = (text or "").encode(), []
    kind = [next((k for k, chars in enumerate(mil_quality.CLASSES) if b < 128 and chr(b) in chars), len(mil_quality.CLASSES) + (b < 128)) for b in data]
    for a in range(0, max(1, len(data)), mil_quality.PASSAGE_BYTES):
        end = min(len(data), a + mil_quality.PASSAGE_BYTES)
        x = np.zeros(mil_quality.WIDTH)
        k, n, wide = mil_quality.N_CLASSES, max(1, end - a), mil_quality.N_CLASSES * (mil_quality.N_CLASSES + 1)
        for i in range(a, end):
            x[kind[i]] += 1 / n
            if i + 1 < len(data):  # a pair or three belong to the passage that they begin in
                x[k + kind[i] * k + kind[i + 1]] += 1 / n
            if i + 2 < len(data):
                mixed = (data[i] * 0x9E3779B1 ^ data[i + 1] * 0x85EBCA77 ^ data[i + 2] * 0xC2B2AE3D) % 2**32 >> 24
                x[wide + mixed] += 1 / n
        x = np.sqrt(x)
        x[-1] = n / mil_quality.PASSAGE_BYTES
        out.append(x)
    return np.array(out)


def test_quality_is_that_of_a_plain_version():
    """Features, attention and scores against loops over passages."""
    texts = [None, "", "a", "ab", "Good text, of words.\n" * 90, "é日" * 400, "#$% |~" * 10]
    x, counts = mil_quality.passage_features(texts)
    want = [plain_passages(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert np.allclose(x, np.concatenate(want), atol=1e-6)
    m = mil_quality.fit(x, counts, np.array([0, 0, 0, 1, 1, 1, 0]), steps=20)
    for got, bag in zip(m.scores(texts), want, strict=True):
        h = [np.tanh(((p - m.mean) * m.scale) @ m.w + m.b) for p in bag]
        e = [np.exp(sum(np.tanh(v @ m.v) * (1 / (1 + np.exp(-(v @ m.u)))) * m.a)) for v in h]
        z = sum(w * v for w, v in zip(e, h, strict=True)) / sum(e)
        assert got == pytest.approx(1 / (1 + np.exp(-(z @ m.c + m.d))), abs=1e-3)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(7, 1), (5, 0), (8, 1), (8, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = mil_quality.train_quality(odd(spark), labels)
    got = mil_quality.score_quality(odd(spark).withColumn("score", F.lit("s")), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert mil_quality.score_quality(odd(spark).limit(0), model).count() == 0
    assert mil_quality.train_quality(odd(spark), labels.limit(0)) == 0.5
