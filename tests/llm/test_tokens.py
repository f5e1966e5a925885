import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagequarry.llm import byte_bpe, mix_packing, queries, sp_encode, token_counts
from pagequarry.llm.sp_model import Normaliser, PieceModel, read_char_map

MIXED = "abcdefgh eiouthn   \n.,!?0123éü漢字▁ЖдЯ=-_()"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return PieceModel(queries.piece_model())


def strings(alphabet, many=600, longest=120):
    draw = random.Random(3)
    odd = ["", " ", "  ", "\n", "a  b", "   x\t\ty  ", "漢字テスト", "<s> </s> <0x0A>", "▁a ▁▁b", "a" * 400, "-" * 500,
           "\x00\x01 a", " " * 100, "the " * 90]
    return odd + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, longest))) for _ in range(many)]


def test_encoding_offsets_and_decoding_are_the_librarys(model, library):
    encoder = sp_encode.Encoder(model)
    for text in strings(MIXED):
        ids, begins, ends = encoder.encode(text)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces], text
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in proto.pieces], text
        assert model.decode(ids.tolist()) == library.decode(ids.tolist()), text


def test_decoding_of_any_ids(model, library):
    draw = random.Random(4)
    for _ in range(300):
        ids = [draw.randrange(model.surface.__len__()) for _ in range(draw.randint(0, 12))]
        ids += [draw.randrange(3, 259) for _ in range(draw.randint(0, 6))]
        assert model.decode(ids) == library.decode(ids), ids


def test_counts_do_not_depend_on_chunks(model, library):
    machine = token_counts.Transducer(model)
    for text in strings(MIXED, 300):
        want = len(library.encode(text))
        for width in (1, 3, 17, 1000):
            assert machine.chunk_counts(text, width)[-1:] == ([want] if text else [])


def test_maps_compose_in_any_grouping(model):
    machine = token_counts.Transducer(model)
    for text in strings(MIXED, 100, 90):
        text = model.normaliser.text(text)
        cuts = machine.cuts(len(text), 17)
        maps = [machine.chunk(text, a, b) for a, b in zip(cuts, cuts[1:])]
        if len(maps) < 3:
            continue
        a, b, c = maps[0], maps[1], maps[2]
        assert machine.compose(machine.compose(a, b), c) == machine.compose(a, machine.compose(b, c))


def test_every_entry_of_a_map_is_a_run_from_its_start(model):
    """Brute force: for each start a piece may have before the cut, and each exit, the encoding of
    the text between them, if its first piece reaches over the cut."""
    machine, compared = token_counts.Transducer(model), 0
    for text in strings("theinrsao aA-=", 40, 60) + ["a" * 70, "-=" * 40, " " * 60, "ab" * 40]:
        text = model.normaliser.text(text)
        for begin in range(0, max(len(text) - 20, 0), 7):
            for end in {begin + 18, len(text)}:
                found = machine.chunk(text, begin, end)
                for read in machine.entries(text, begin) if begin else [""]:
                    begun = begin - len(read)
                    exits = machine.entries(text, end) if end < len(text) else [""]
                    for left in exits:
                        pieces = model.merge(text[begun : end - len(left)])
                        span = found.get(read, {}).get(left)
                        if len(pieces[0]) <= len(read):
                            assert span is None
                            continue
                        compared += 1
                        assert (span.first, span.tokens) == (pieces[0], sum(map(machine.tokens, pieces)))
                        assert span.last in (None, pieces[-1])
    assert compared > 1000


def test_every_state_counts_the_prefix_it_has_read(model):
    machine = token_counts.Transducer(model)
    for text in strings("theinrsao aA-=é漢", 60, 50):
        state, tokens = machine.start, 0
        for at, char in enumerate(text, 1):
            state, change = state[char]
            tokens += change
            assert tokens == sum(map(machine.tokens, model.merge(text[:at])))


def test_a_full_table_of_states_is_compiled_anew(model, library):
    machine = token_counts.Transducer(model, most=40)
    for text in strings(MIXED, 60):
        want = len(library.encode(text))
        assert machine.walk(model.normaliser.text(text)) == want
        assert machine.chunk_counts(text, 20)[-1:] == ([want] if text else [])
        assert len(machine.states) <= 40


def test_long_texts_are_counted_in_rows(spark, library):
    from pyspark.sql import types as T

    draw = random.Random(8)
    texts = ["".join(draw.choice(MIXED) for _ in range(n)) for n in (5000, 300, 2100)]
    texts += ["a" * 3000, "-" * 2500, " " * 2000, "", None, "漢" * 1500, texts[0]]
    rows = [(n % 8 or None, t) for n, t in enumerate(texts)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    frame = spark.createDataFrame(rows, schema)
    got = token_counts.count_tokens(frame, queries.piece_model(), width=64, spread=500).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    order = lambda row: (row[0] or 0, row[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_character_map_is_read_and_applied_by_longest_prefix():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    rules = spec.normalizer_spec
    ours = Normaliser(
        read_char_map(rules.precompiled_charsmap), rules.add_dummy_prefix, rules.remove_extra_whitespaces,
        rules.escape_whitespaces,
    )
    for text in strings("ﬁＡ①é é　ｱﾞ½  ab\t\xad​", 1500, 30):
        want, places = library.normalize(text, with_offsets=True)
        got, starts = ours.aligned(text)
        if text:
            assert (got, starts.tolist()) == (want, [len(text[:p].encode()) for p in places]), text


def test_counts_and_encoding_of_odd_rows(odd, none, library):
    counted = token_counts.count_tokens(odd, queries.piece_model()).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]}
    assert len(counted) == odd.count()
    for r in counted:
        if r["doc_id"]:
            text = texts[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text)))
    encoded = sp_encode.encode(odd, queries.piece_model()).collect()
    assert len(encoded) == odd.count()
    for r in encoded:
        if r["doc_id"]:
            text = texts[r["doc_id"]] or ""
            assert r["ids"] == library.encode(text) and r["decoded"] == library.decode(r["ids"])
            assert not r["ends"] or r["ends"][-1] == len(text.encode())
    assert token_counts.count_tokens(none, queries.piece_model()).count() == 0
    assert sp_encode.encode(none, queries.piece_model()).count() == 0


def test_two_runs_over_a_chunk_meet_or_go_on_apart(library):
    machine = token_counts.Transducer(token_counts.load(queries.piece_model(), {}))
    for text in ("ab" * 3000, "one two  three, four" * 300, "a" * 9000, "-=" * 4000, MIXED * 150):
        for width in (1000, 4500):
            assert machine.chunk_counts(text, width)[-1] == len(library.encode(text)), (text[:20], width)


def test_token_queries_over_a_whole_table(spark, docs, library):
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op3(spark, "/root/testdata/sf0.001").collect():
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 4096)
    for r in queries.op4(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# ---------------------------------------------------------------- packing

@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_byte_ids_are_the_librarys(byte_library):
    ours = byte_bpe.ByteBpe(queries.byte_tokenizer())
    low = "".join(map(chr, range(0x250)))
    for alphabet in (low, "abc  \n\t'sdré.,1²½ \xa0\x85\x1c", MIXED):
        for text in [*strings(alphabet, 1500, 40), "a <|endoftext|> b"]:
            got = np.frombuffer(ours.encode(text), ours.kind).tolist()
            assert got == byte_library.encode(text, add_special_tokens=False).ids, text


def check_packing(pieces, texts, byte_library, window):
    """Every id in one piece, windows gapless and full but for the last."""
    by_doc, by_window = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = byte_library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["crc"]
            at += r["length"]
        assert at == len(ids)
    last = max(by_window)
    assert sorted(by_window) == list(range(last + 1))
    for number, own in by_window.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == window if number < last else at <= window


@pytest.mark.parametrize("window", [64, 2048])
def test_packing_a_table(docs, byte_library, window):
    pieces = mix_packing.pack(docs, queries.byte_tokenizer(), window=window).withColumn("crc", F.crc32("ids")).collect()
    check_packing(pieces, {r["doc_id"]: r["text"] for r in docs.collect()}, byte_library, window)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    total, share, last = 0, {}, max(r["sequence_id"] for r in pieces)
    for r in pieces:
        share[source[r["doc_id"]]] = share.get(source[r["doc_id"]], 0) + r["length"]
        total += r["length"]
    own = {}
    for r in pieces:
        own[r["sequence_id"], source[r["doc_id"]]] = own.get((r["sequence_id"], source[r["doc_id"]]), 0) + r["length"]
    for (number, name), n in own.items():
        # A window is off its shares by less than a token or two per queue, at either end.
        assert number == last or abs(n - window * share[name] / total) <= 2 * len(share) + 2


def test_given_targets_hold_until_a_source_runs_dry(spark, byte_library):
    rows = [(i, "word " * 200, "ab"[i % 2]) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    pieces = mix_packing.pack(table, queries.byte_tokenizer(), targets={"a": 3, "b": 1}, window=128)
    pieces = pieces.withColumn("crc", F.crc32("ids")).collect()
    check_packing(pieces, {i: t for i, t, _ in rows}, byte_library, 128)
    first = [sum(r["length"] for r in pieces if r["sequence_id"] == 3 and r["doc_id"] % 2 == k) for k in (0, 1)]
    assert abs(first[0] - 96) <= 3 and abs(first[1] - 32) <= 3


def test_more_sources_than_queues_and_no_broadcast(docs, byte_library):
    pieces = mix_packing.pack(docs, queries.byte_tokenizer(), most_queues=3, broadcast_rows=0)
    pieces = pieces.withColumn("crc", F.crc32("ids")).collect()
    check_packing(pieces, {r["doc_id"]: r["text"] for r in docs.collect()}, byte_library, 2048)
    assert {r["queue"] for r in pieces} <= {0, 1, 2}


@pytest.mark.parametrize("most", [2, 4, 8])
def test_many_sources_keep_their_shares(spark, byte_library, most):
    # Each source's documents lie together, so a queue that isn't mixed inside sends them one source after the other.
    rows = [(i, "word " * (20 + i % 7), None if i < 25 else f"s{i // 25}") for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartitionByRange(5, "doc_id")
    pieces = mix_packing.pack(table, queries.byte_tokenizer(), window=256, most_queues=most)
    pieces = pieces.withColumn("crc", F.crc32("ids")).collect()
    check_packing(pieces, {i: t for i, t, _ in rows}, byte_library, 256)
    total = sum(r["length"] for r in pieces)
    sent = np.zeros((40, max(r["sequence_id"] for r in pieces) + 1))
    for r in pieces:
        sent[r["doc_id"] // 25, r["sequence_id"]] += r["length"]
    even = sent.sum(1)[:, None] * np.minimum(1, (np.arange(sent.shape[1]) + 1) * 256 / total)
    assert np.abs(np.cumsum(sent, 1) - even).max() <= 16  # a token or two a level of the tree
    assert {r["queue"] for r in pieces} <= set(range(most))


def test_targets_of_more_sources_than_queues(spark, byte_library):
    rows = [(i, "word " * 60, f"s{i // 20}") for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartitionByRange(4, "doc_id")
    targets = {"s0": 10, "s1": 5} | {f"s{k}": 1 for k in range(2, 20)}
    pieces = mix_packing.pack(table, queries.byte_tokenizer(), targets=targets, window=256, most_queues=6)
    pieces = pieces.withColumn("crc", F.crc32("ids")).collect()
    check_packing(pieces, {i: t for i, t, _ in rows}, byte_library, 256)
    half = 20 * 61 * 33 / 10 // 256  # s0 runs dry after twice as many windows
    early = np.zeros(30)
    for r in pieces:
        early[r["doc_id"] // 20] += r["length"] * (r["sequence_id"] < half // 2)
    sent = half // 2 * 256
    assert abs(early[0] - sent * 10 / 33) <= 8 and abs(early[1] - sent * 5 / 33) <= 8
    assert np.abs(early[2:20] - sent / 33).max() <= 8 and early[20:].max() <= 1


def test_tree_and_flat_schedule_place_every_token_once():
    draw = np.random.default_rng(4)
    for most in (2, 3, 5, 64):
        n = int(draw.integers(1, 40))
        totals = draw.integers(1, 300, n).tolist()
        shares = (draw.random(n) * (draw.random(n) < 0.7)).tolist()
        tree = mix_packing.Tree(totals, shares, most, 50)
        plans = [mix_packing.Schedule(*node) for node in zip(tree.totals, tree.shares, tree.rounds)]
        assert max(len(t) for t in tree.totals) <= most and tree.top().max() < most
        doc, start, size, at = mix_packing.windows(
            *tree.pieces(plans.__getitem__, np.arange(n), np.zeros(n, np.int64), np.array(totals)), 50
        )
        assert (np.diff(doc) >= 0).all()
        places = np.concatenate([np.arange(a, a + k) for a, k in zip(at, size)])
        tokens = np.concatenate([np.arange(a, a + k) + 1000 * d for d, a, k in zip(doc, start, size)])
        assert sorted(places) == list(range(sum(totals)))
        assert tokens.tolist() == [1000 * d + t for d in range(n) for t in range(totals[d])]


def test_packing_odd_rows(odd, none, byte_library):
    pieces = mix_packing.pack(odd, queries.byte_tokenizer()).collect()
    want = sum(len(byte_library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r["length"] for r in pieces) == want == sum(len(r["ids"]) // 4 for r in pieces)
    assert mix_packing.pack(none, queries.byte_tokenizer()).count() == 0


def test_schedule_sends_every_token_once():
    draw = np.random.default_rng(2)
    for _ in range(40):
        n = int(draw.integers(1, 6))
        totals = draw.integers(0, 5000, n).tolist()
        shares = draw.random(n).tolist()
        plan = mix_packing.Schedule(totals, shares, 100)
        rounds = np.arange(plan.rounds[-1] + 1)
        sent = plan.sent(rounds)
        assert (np.diff(sent, axis=0) >= 0).all() and sent[-1].tolist() == totals
        for q in range(n):
            tokens = np.arange(totals[q])
            at = plan.round_of(np.full(totals[q], q), tokens)
            assert (sent[at, q] <= tokens).all() and (sent[at + 1, q] > tokens).all()
