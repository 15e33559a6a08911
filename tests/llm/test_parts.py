"""Parts of the operators that need no session."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import chat_masks, near_duplicates, sharding, token_files, warc_archive

TEXTS = st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60)
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODER = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most_known=50)


@given(st.lists(st.integers(-(2**40), 2**62), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values = np.array(sorted(values), np.int64)
    coded = token_files.EliasFano.of(values)
    assert coded.slice(0, len(values)).tolist() == values.tolist()
    read = token_files.EliasFano.read(coded.head(), coded.tobytes())
    assert [read.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    for i in range(0, len(values), 11):
        assert read.slice(i, i + 5).tolist() == values[i:i + 5].tolist() if i + 5 <= len(values) else True
    assert read.slice(len(values), len(values)).tolist() == []


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    coded = token_files.EliasFano.of(ends)
    assert 8 * len(coded.tobytes()) < 12.5 * len(ends) and 8 * coded.directory.nbytes < 0.2 * len(ends)
    assert [coded.select(i) for i in (0, 511, 512, 99_999)] == ends[[0, 511, 512, 99_999]].tolist()


@given(st.lists(TEXTS | st.sampled_from(["can't", "<|endoftext|>", "A\x1cb", "é", "ßİ", "x\x00y", "1,5"]), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_give_the_ids_of_the_text(parts):
    for text in (" ".join(parts), "".join(parts)):
        want = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ENCODER.encode([text])[0], ENCODER.id_type).tolist() == want


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|turn|>"]), TEXTS | st.sampled_from(
    ["<|turn|>", "<\\|end|>", "<", "|", " a ", "<\\\\|body|>"])), max_size=6))
@settings(max_examples=100, deadline=None)
def test_turns_and_masks_come_back(turns):
    text, spans = chat_masks.rendered(turns)
    assert chat_masks.parsed(text) == turns
    got = chat_masks.mark_tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False)
    masks = chat_masks.token_masks(np.array(got.offsets).reshape(-1, 2), spans)
    masked = "".join(chat_masks.unescaped(text[m["start"]:m["stop"]]) for m in masks)
    assert masked == "".join(x for role, x in turns if role == "assistant")
    for m in masks:  # no mark is under the mask
        assert not {50257, 50258, 50259} & set(got.ids[m["first_token"]:m["last_token"]])


def test_registers_and_estimates():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    sets = [np.unique(pool[:1000]), np.unique(pool[100:1100]), np.unique(pool[1000:]), pool[:1]]
    signs = near_duplicates.registers(sets)
    sizes = np.array([len(s) for s in sets])
    got = near_duplicates.estimates(signs[0], 1000, signs, sizes)
    assert got[0] == 1 and abs(got[1] - 900 / 1100) < 0.15 and abs(got[2]) < 0.05
    values = np.array([[2**63, 2**63 - 1, 1, 0b1011 << 40]], np.uint64)
    assert near_duplicates.compressed(values).tolist() == [[0, (1 << 10) | 1023, 63 << 10, (20 << 10) | (0b011 << 7)]]


def test_group_links_join_what_is_linked():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 2**64, k, dtype=np.uint64)])) for k in range(0, 60, 2)]
    links = near_duplicates.group_links(list(range(30)), sets, np.zeros(30, bool), 80)
    root = list(range(30))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        root[find(a)] = find(b)
    want = list(range(30))
    for i in range(30):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                want = [want[j] if w == want[i] else w for w in want]
    parts = {frozenset(i for i in range(30) if find(i) == f) for f in map(find, range(30))}
    assert parts == {frozenset(i for i in range(30) if want[i] == w) for w in want}


def test_shards_cut_nearest_to_even_shares():
    got = sharding._places({0: (5, 1), 1: (5, 2), 2: (10, 1), 3: (1, 4)}, 2, 21)
    assert got == {0: {"shard": 0, "base": 0}, 1: {"shard": 0, "base": 1}, 2: {"shard": 1, "base": 0}, 3: {"shard": 1, "base": 1}}


def test_a_reader_is_not_misled_by_what_looks_like_a_member(tmp_path):
    import pyarrow.fs as pafs

    info = "<urn:uuid:own>"
    inner = warc_archive._packed(warc_archive._record([("WARC-Type", "response"), ("WARC-Warcinfo-ID", "<urn:uuid:other>")], b"x"), 6)
    out, starts = b"", []
    for n in range(40):
        starts.append(len(out))
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{n}>"), ("WARC-Warcinfo-ID", info)]
        # level 0 stores the block as it is, the other archive's record and bare magic included
        out += warc_archive._packed(warc_archive._record(fields, inner * 3 + warc_archive.MAGIC * 5), 0)
    (tmp_path / "a.warc.gz").write_bytes(out)
    filesystem, path = pafs.FileSystem.from_uri(f"file://{tmp_path}/a.warc.gz")
    for size in (7, 100, 1000, len(out)):
        with filesystem.open_input_file(path) as source:
            got = [f["WARC-Record-ID"] for a in range(0, len(out), size)
                   for f, _ in warc_archive.records_in(source, a, min(a + size, len(out)), info)]
        assert got == [f"<{n}>" for n in range(40)]


def test_a_split_may_start_at_a_record_with_a_long_header(tmp_path):
    import pyarrow.fs as pafs

    info = "<urn:uuid:own>"
    for late in (False, True):  # the archive's id before the address, and after it
        out, starts = b"", []
        for n in range(4):
            starts.append(len(out))
            named = [("WARC-Warcinfo-ID", info), ("WARC-Target-URI", "x" * n + "\u00e9\u20ac" * 2000)]
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{n}>"), *(named[::-1] if late else named)]
            out += warc_archive._packed(warc_archive._record(fields, b"block"), 6)
        (tmp_path / "a.warc.gz").write_bytes(out)
        filesystem, path = pafs.FileSystem.from_uri(f"file://{tmp_path}/a.warc.gz")
        with filesystem.open_input_file(path) as source:
            for a, b in zip(starts, [*starts[1:], len(out)]):
                [(fields, block)] = warc_archive.records_in(source, a, b, info)
                assert fields["WARC-Record-ID"] == f"<{starts.index(a)}>" and block == b"block"
