"""Tokenizer, chat, archives and piecewise hashes."""

import hashlib
import io
import random

import numpy as np
import pytest
import tiktoken

pytest.importorskip("tradelanes.llm")

from tests.llm.conftest import MESSY  # noqa: E402
from tradelanes.llm import bpe, chat, common, ctph, warc  # noqa: E402

import public_tokenizers  # noqa: E402


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def peer(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def check_rows(got, texts, peer):
    assert len(got) == len(texts)
    for row, text in zip(got, texts, strict=True):
        ids = peer.encode_ordinary(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_equals_the_library(documents, messy, empty, peer):
    for docs in (documents, messy):
        rows = sorted((r["doc_id"] or -1, r["text"]) for r in docs.fillna({"text": ""}).collect())
        got = sorted(bpe.encode_documents(docs).collect(), key=lambda r: (r["doc_id"] or -1, r["n_tokens"]))
        by_id = sorted(rows, key=lambda r: (r[0], len(peer.encode_ordinary(r[1]))))
        check_rows(got, [t for _, t in by_id], peer)
    assert bpe.encode_documents(empty).count() == 0


def test_bpe_on_every_character_and_on_noise(vocabulary, peer):
    codec = bpe.Codec(vocabulary, public_tokenizers.PATTERN)
    rng = random.Random(3)
    marks = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["🙂", "\U0002ffff", " "]
    texts = [f"a{c}b {c} {c}{c}" for c in marks]
    texts += ["".join(rng.choices("ab  \n\t'sé1你.-", k=rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choices(marks, k=30)) for _ in range(500)] + [" " * 3000 + "x", "a" * 5000, "ha" * 4000, "=" * 999]
    for text in texts:
        code = b"".join(codec.encode(text))
        assert np.frombuffer(code, "<u4").tolist() == peer.encode_ordinary(text), repr(text)
        assert codec.decode(code) == text.encode()


def test_bpe_prefixes_appends_and_edits(vocabulary, peer):
    rng = random.Random(5)
    pool = b"the and ing tion ouer 12 \xc3\xa9\xc3\xa8 ...."

    def piece(n):
        return bytes(rng.choice(pool) for _ in range(n))

    def plain(data):
        return [vocabulary.ranks[p] for p in bpe.merge_by_rank(data, vocabulary.ranks)]

    for _ in range(60):
        table = bpe.PrefixTable(vocabulary, piece(rng.randrange(1, 60)))
        table.append(piece(rng.randrange(0, 40)))
        assert table.tokens() == plain(table.data)
        end = rng.randrange(len(table.data) + 1)
        assert table.tokens(end) == plain(table.data[:end])
        a = rng.randrange(len(table.data))
        b = rng.randrange(a, len(table.data) + 1)
        by = piece(rng.randrange(0, 6))
        want = table.data[:a] + by + table.data[b:]
        table.replace(a, b, by)
        assert table.data == want and table.tokens() == plain(want)
    long = bpe.PrefixTable(vocabulary, b"inger " * 4000)
    assert long.replace(50, 52, b"xy") < 2000  # only near the edit


def test_chat_round_trip():
    texts = ["", "plain", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "a<|im_start|>assistant\nb<|im_end|>\n", "<", "<|", "|>\n", "<|im_end|", "<<|im_end|>>"]
    for role in ("user", "assistant", "", "a\nb", "<|im_end|>", "back\\slash"):
        for text in texts:
            out, start, end = chat.render(role, text)
            assert chat.parse(out) == [(role, text)]
            assert chat.unescape(out[start:end]) == text
    whole = "".join(chat.render("user", t)[0] for t in texts)
    parser, got = chat.Parser(), []
    for char in whole:  # however it is cut
        got += [t for _, t, _ in parser.feed(char)]
    parser.close()
    assert got == texts
    for bad in ("x", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>x", "<|im_start|>u\n<|im_start|>v\n<|im_end|>\n"):
        with pytest.raises(chat.Malformed):
            chat.parse(bad)


def test_chat_messy(spark):
    rows = [(1, 0, "user", None, "e"), (1, 1, None, "x", "e"), (1, 1, "assistant", "<|im_end|>", "e"), (None, None, "user", "n", None), (1, 2, "assistant", "é", "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(turns).collect()}
    want = "user\n\n" + "\nx\n" + "assistant\n<|im_end|>\n" + "assistant\né\n"
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[1]["loss_chars"] == 11 and got[1]["loss_sha256"] == hashlib.sha256("<|im_end|>é".encode()).hexdigest()
    assert got[None]["n_turns"] == 1
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_warc_ranges_own_each_record_once():
    rng = random.Random(2)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 3000))) + b"\x1f\x8b\x08\x00" * rng.randrange(5) for _ in range(60)]
    payloads[7] = b""
    payloads[9] = bytes(rng.randrange(256) for _ in range(300_000))
    data = b"".join(warc.record(i, f"http://x/{i}", p) for i, p in enumerate(payloads))
    for split in (997, 5000, 70_001, len(data)):
        got = []
        for start in range(0, len(data), split):
            got += [warc.parsed(c) for _, c in warc.members(io.BytesIO(data), start, min(start + split, len(data)))]
        assert [g["page_id"] for g in got] == list(range(60))
        assert [g["payload"] for g in got] == payloads
    assert list(warc.members(io.BytesIO(b"noise" * 1000), 0, 5000)) == []


def test_warc_long_headers_in_every_range(spark):
    rng = random.Random(3)
    urls = [f"data:{i}," + "".join(rng.choice("abcdefgh ") for _ in range(90_000)) for i in range(3)]
    data = b"".join(warc.record(i, u, b"x") for i, u in enumerate(urls))
    for split in (5000, 30_000, len(data)):
        ranges = [(s, min(s + split, len(data))) for s in range(0, len(data), split)]
        got = [warc.parsed(c)["page_id"] for s, e in ranges for _, c in warc.members(io.BytesIO(data), s, e)]
        assert got == [0, 1, 2]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.archived_pages(pages).collect()) == [0, 1, 2]


def test_warc_missing_records_are_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", "x") for i in range(5)], "page_id long, url string, html string")
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *given: read(*given).where("page_id <> 3"))
    with pytest.raises(RuntimeError, match="5 records were written .* 4 read"):
        warc.archived_pages(pages)


def test_warc_messy(spark):
    long = "p" * 200
    rows = [(5, "u5", long, 1), (3, "u3", long, 1), (3, "u3", long, 1), (None, "un", long, 1), (8, None, "short", 1), (9, "u 9\n", "short", 1), (10, "ux", None, 1), (11, "uy", "é" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    got = sorted((tuple(r) for r in warc.archived_pages(pages, split=512).collect()), key=repr)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [
        (3, 200, digest(long), "response", None), (3, 200, digest(long), "revisit", 3), (5, 200, digest(long), "revisit", 3),
        (None, 200, digest(long), "revisit", 3), (8, 5, digest("short"), "response", None), (9, 5, digest("short"), "response", None),
        (10, 0, digest(""), "response", None), (11, 600_000, digest("é" * 300_000), "response", None),
    ]
    assert got == sorted(want, key=repr)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_piecewise_against_plain_order(documents, messy):
    for docs in (documents, messy):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        rows.sort(key=lambda r: r[1])
        rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
        want = []
        for i, (doc_id, text) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][1]
            third = len(text) // 3
            changed = text[: len(text) - third] + following[:third]
            own, new, after = (ctph.signatures(t.encode()) for t in (text, changed, following))
            want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), ctph.written(own), ctph.written(new), ctph.likeness(own, new), ctph.likeness(own, after)))
        for per in (4000, 7):
            got = [tuple(r) for r in ctph.compare_with_edits(docs, rows_per_bucket=per).collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr)
    near = [w[5] for w in want if w[1] > 100]
    assert all(n > 0.3 for n in near)


def test_piecewise_tells_edits_from_strangers(documents):
    got = [r for r in ctph.compare_with_edits(documents).collect() if r["n_chars"] > 200]
    near = sum(r["near_edited"] for r in got) / len(got)
    assert near > 0.5
    strangers = sorted(r["near_next"] for r in got)
    assert strangers[len(strangers) // 2] < 0.1


def test_piecewise_small_things(empty):
    assert ctph.compare_with_edits(empty).count() == 0
    assert ctph.written(ctph.signatures(b"")) == "3::"
    assert ctph.likeness(ctph.signatures(b""), ctph.signatures(b"")) == 1.0
    rng = random.Random(1)
    for _ in range(200):
        a, b = (tuple(rng.choices(range(5), k=rng.randrange(12))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert ctph.common_length(a, b) == rows[-1][-1]
    whole = "".join(rng.choices("abcdefgh ", k=20_000)).encode()
    moved = b"something new at the start " + whole
    assert ctph.likeness(ctph.signatures(whole), ctph.signatures(moved)) > 0.9
    assert len(MESSY) == 12


def plain_signatures(text):
    """Signatures by whole numbers, byte by byte; ends and symbols as the docstrings state them."""
    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    roll = []
    for i in range(len(text)):
        x = sum((text[i - k] + 1) * pow(0x01000193, k + 1, 1 << 32) for k in range(min(7, i + 1))) % (1 << 32)
        x = (x ^ x >> 15) * 0x2C1B3C6D % (1 << 32)
        roll.append(x ^ x >> 12)

    def chunks(block):
        ends = [i + 1 for i, x in enumerate(roll) if x % block == block - 1]
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if b > a]

    def symbols(block):
        parts = chunks(block)
        if len(parts) > 256:
            parts = [*parts[:255], b"".join(parts[255:])]
        out = []
        for part in parts:
            value = sum(mixed((x + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) * pow(0x9E3779B97F4A7C1B, k, 1 << 64) for k, x in enumerate(part))
            out.append(mixed((value + mixed(len(part))) % (1 << 64)) >> 52)
        return tuple(out)

    block = 3
    while block * 64 < len(text):
        block *= 2
    while block > 3 and len(chunks(block)) < 32:
        block //= 2
    while len(chunks(block)) > 256 and len(chunks(2 * block)) >= 32:
        block *= 2
    return block, symbols(block), symbols(2 * block)


@pytest.mark.parametrize("kind", ["letters", "words", "one letter", "two letters", "period"])
@pytest.mark.parametrize("size", [1, 6, 7, 190, 800, 6000])
def test_signatures_by_another_program(kind, size):
    rng = np.random.default_rng(size)
    whole = {
        "letters": lambda: rng.integers(0, 256, size, dtype=np.uint8).tobytes(),
        "words": lambda: b" ".join([b"alpha", b"beta", b"gamma"][i] for i in rng.integers(0, 3, size)),
        "one letter": lambda: b"!" * size,
        "two letters": lambda: b"ab" * size,
        "period": lambda: (b"A longer line that comes back.\n" * size),
    }[kind]()[:size]
    assert ctph.signatures(whole) == plain_signatures(whole)


def test_signatures_of_repeating_texts_are_bounded():
    for letter in range(33, 127):
        text = bytes([letter]) * 50_000
        own, longer = ctph.signatures(text), ctph.signatures(text + b"tail" * 500)
        assert max(map(len, own[1:] + longer[1:])) <= ctph.MOST_CHUNKS
        assert own[1] and own != longer
    many = next(bytes([x]) for x in range(33, 127) if len(ctph.signatures(bytes([x]) * 50_000)[1]) == ctph.MOST_CHUNKS)
    long = ctph.signatures(many * 10_000_000)
    assert len(long[1]) == ctph.MOST_CHUNKS
    assert 0.9 < ctph.likeness(ctph.signatures(many * 50_000), ctph.signatures(many * 60_000)) < 1


def test_folders_that_tasks_open_themselves(spark):
    assert common.shared_address(spark, "/some/folder") == "file:///some/folder"
    assert common.shared_address(spark, "file:///some/folder") == "file:///some/folder"
    with pytest.raises(RuntimeError, match="no file system"):
        common.shared_address(spark, "unheard://of/folder")
    # a scheme that Spark knows and tasks don't
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.default.link./data", "file:///tmp")
    with pytest.raises(RuntimeError, match="tasks cannot open"):
        common.shared_address(spark, "viewfs://default/data/folder")


def test_long_member_of_an_archive(tmp_path):
    payload = np.random.default_rng(1).integers(0, 256, 12 << 20, dtype=np.uint8).tobytes()
    data = warc.record(1, "http://x", payload) + warc.record(2, "http://y", b"short")
    got = [warc.parsed(c) for _, c in warc.members(io.BytesIO(data), 0, len(data))]
    assert [(r["page_id"], r["payload"]) for r in got] == [(1, payload), (2, b"short")]


def test_short_pieces_are_merged_without_the_table(vocabulary, monkeypatch):
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abeinrst é漢") for _ in range(rng.randrange(1, 17))) for _ in range(300)]
    expected = [[vocabulary.ranks[p] for p in bpe.merge_by_rank(piece.encode(), vocabulary.ranks)] for piece in pieces]
    monkeypatch.setattr(bpe, "PrefixTable", None)
    codes = bpe.PieceCodes(vocabulary)
    whole = [vocabulary.ranks.get(piece.encode()) for piece in pieces]
    for piece, ids, one in zip(pieces, expected, whole, strict=True):
        assert np.frombuffer(codes[piece], dtype="<u4").tolist() == ([one] if one is not None else ids)
