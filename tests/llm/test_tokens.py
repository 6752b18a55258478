"""Encoding, counts, files and packing against the tokenizers library."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from squallbars.llm.bin_genetics import best_fit, bins, crossover, evolve, fill, mutated
from squallbars.llm.encoding import encoder
from squallbars.llm.packing import pack
from squallbars.llm.token_counts import token_counts
from squallbars.llm.token_files import LAYOUT, read_tokens, token_digests, write_tokens
from squallbars.session import shared_dir

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_library_ids(path):
    with open(path, "rb") as f:
        own = encoder(f.read())
    rng = random.Random(3)
    marks = [" ", " ", "\n", "\t", "a", "B", "É", "ß", "1", "2", ".", ",", "'s", "<|endoftext|>", "\x1c", "中", "́", "😀", "  ", "½", " ", "_", "Σ", "'S", "re", "　", "İ"]
    texts = ["".join(rng.choice(marks if rng.random() < 0.7 else marks[:13]) for _ in range(rng.randint(0, 14))) for _ in range(5_000)]
    texts += ["x" * 300 + " " + "y" * 90, None, " ", "\n \n", "a  b   c", "end ", "\n ", "<|startoftext|> x", "a\x00b \x01 \x02é \x02", "q" * 700 + "é z", "Z" * 600 + " z"]
    known = Tokenizer.from_file(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in known.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert own.encode_texts(texts) == want
    assert own.encode_texts(texts) == want  # from the cache
    flat, counts = own.encode_flat(texts, b"\2\0\0\0")
    assert flat.tobytes() == b"".join(w + b"\2\0\0\0" for w in want) and counts.tolist() == [len(w) // 4 + 1 for w in want]
    assert [len(x) for x in own.encode_flat([])] == [0, 0]


def test_latin_letters_are_merged_without_the_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    letters = "abcXYZ019'.-" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    texts = ["Été ÜBER daß' ñandú'll Çà2ÿ", *(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(40))]
    odd = [t + " ".join(rng.choice(["e\u0301", "\u00b5m", "3\u00d74\u00f75", "\u00aa", "x\u00b2", "\u0130\u03a3", "a\u00a0b", "\u0301a"]) for _ in range(9)) for t in texts]
    rules = encoder(open(path, "rb").read())
    want = [ids(path, t) for t in texts + odd]
    assert [np.frombuffer(i, "<u4").tolist() for i in rules.encode_texts(texts + odd)] == want
    monkeypatch.setattr(rules, "_look_up", None)
    assert [np.frombuffer(i, "<u4").tolist() for i in rules.encode_texts(texts)] == want[:len(texts)]


def test_counts_of_pieces_with_many_tokens(spark):
    """64 characters beyond the basic plane are a frequent piece of 256 tokens, one for each byte."""
    rows = [(1, "\U00012000" * 64), (2, "\U00012000" * 64 + " \U00012000"), (3, "\U00012000" * 65)]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).collect()}
    assert got == {i: len(ids(BYTES, t)) for i, t in rows} and got[1] == 256


def test_counts(edges, empty):
    got = token_counts(edges, BYTES).collect()
    want = {(r.doc_id, r.text): len(ids(BYTES, r.text)) for r in edges.collect()}
    assert sorted(str((r.n_tokens, r.n_bytes)) for r in got) == sorted(str((n, len((t or "").encode()))) for (i, t), n in [((r.doc_id, r.text), want[(r.doc_id, r.text)]) for r in edges.collect()])
    assert token_counts(empty, BYTES).count() == 0


def test_files_round_trip(spark, edges, empty):
    folder = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}"
    write_tokens(edges, folder, WORDS)
    rows = read_tokens(spark, folder).orderBy("start").collect()
    order = sorted(edges.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.id for r in rows] == [r.doc_id for r in order]
    start = 0
    for got, want in zip(rows, order, strict=True):
        expected = [*ids(WORDS, want.text), 2]
        assert (list(got.ids), got.n_tokens, got.start) == (expected, len(expected), start)
        start += len(expected)
    crc = {r.start: r.ids_crc32 for r in token_digests(read_tokens(spark, folder)).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    write_tokens(empty, folder + "-none", WORDS)
    assert spark.read.schema("id long, part int, local_start long, n_tokens long, ids array<int>").parquet(folder + "-none").count() == 0


def test_files_have_dictionaries_and_page_indexes(spark, edges):
    import glob

    import pyarrow.parquet as pq

    folder = f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"
    write_tokens(edges, folder, WORDS)
    file = pq.ParquetFile(max(glob.glob(folder.removeprefix("file://") + "/*.parquet")))
    columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)}
    tokens = next(c for n, c in columns.items() if n.startswith("ids"))
    assert "RLE_DICTIONARY" in tokens.encodings and tokens.has_offset_index and tokens.has_column_index
    assert "DELTA_BINARY_PACKED" in columns["local_start"].encodings
    assert LAYOUT["compression"] == "zstd"


def test_packing(edges, empty):
    room = 64
    got = pack(edges, BYTES, room).toPandas()
    assert pack(empty, BYTES, room).count() == 0
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part["offset"].to_numpy() == np.concatenate([[0], part["length"].cumsum()[:-1]])).all()
        assert part["length"].sum() <= room
    texts = [[*ids(BYTES, r.text), 2] for r in edges.collect()]
    assert got["length"].sum() == sum(map(len, texts))
    assert len(got) == sum(-(-len(t) // room) for t in texts)
    whole = got[got.doc_id == 7].sort_values("piece")
    assert (whole["length"].iloc[1:] == room).all() and whole["start"].iloc[1] == whole["length"].iloc[0]
    long_ids = next(t for t, r in zip(texts, edges.collect(), strict=True) if r.doc_id == 7)
    assert [zlib.crc32(np.array(long_ids[a:a + n], "<u4").tobytes()) for a, n in zip(whole["start"], whole["length"])] == whole["ids_crc32"].tolist()


def test_genetics_keep_all_items():
    rng = random.Random(1)
    items = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(60)}

    def held(solution):
        out = {}
        for p, n in solution.items():
            assert fill(p) <= 100
            for length, k in p:
                out[length] = out.get(length, 0) + n * k
        return out

    one, other = best_fit({}, items, 100), best_fit({}, items, 100, rng.sample(sorted(items), len(items)))
    for s in (one, other, crossover(one, other, items, 100, rng), mutated(one, 100, rng), *evolve(items, 100, [], 5)):
        assert held(s) == items
    assert bins(evolve(items, 100, [], 5)[0]) <= bins(one)


def test_best_fit_is_that_of_single_items():
    rng = random.Random(2)
    for _ in range(30):
        items = {rng.randint(1, 50): rng.randint(1, 9) for _ in range(12)}
        free = []
        for x in sorted((x for x, n in items.items() for _ in range(n)), reverse=True):
            fits = [i for i, f in enumerate(free) if f >= x]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= x
            else:
                free.append(50 - x)
        assert bins(best_fit({}, items, 50)) == len(free)
