"""What the operators claim beyond their contracts: verdicts, added kinds, blocks, and clean-up."""

import numpy as np
import public_tokenizers
import pytest

from tests.llm import brute
from tidewatch.llm import chat_masks, line_rules, secret_ledger, shared

SMALL = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_line_verdicts(spark, documents):
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    odd = "Home | Go | Up\nMenu\nA sentence that is long enough, and ends.\nAll rights reserved\nfour words stand here\n a / b / c "
    own += [(10_000 + k, "\n".join(np.random.default_rng(k).permutation(odd.split("\n") * 3)[:n].tolist())) for k, n in enumerate(range(1, 19))]
    got = {r.id: r for r in line_rules.judged_documents(documents(own)).collect()}
    verdicts = {doc: (not failed and brute.kept_text(text)) for (doc, text), (*_, failed) in zip(own, brute.quality(own))}
    assert {doc: r.kept for doc, r in got.items()} == verdicts
    assert 0 < sum(verdicts.values()) < len(verdicts)
    assert any(not r.kept and not r.base_failed for r in got.values())


def test_added_secret_kinds(spark, documents):
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    texts = [
        "-----BEGIN RSA PRIVATE KEY-----\nabc", f"x{jwt}", f"at {jwt}, {jwt}x", "ghp_" + "a" * 36 + " ghp_" + "b" * 35,
        "xoxb-1234567890 sk_live_0123456789abcdef", "see https://me:secret1@host and ftp://a:b@c", "", "-----BEGIN PRIVATE KEY-----" * 2,
        "é https://ü:pässword@x",
    ]
    found = secret_ledger.findings_by_path(documents(list(enumerate(texts))), f"{shared.shared_folder(spark)}/ledger", fresh=True)
    got = {r.path: [(s.start, s.kind, s.end) for s in r.spans if s.kind in brute.MORE_SECRETS] for r in found.collect()}
    assert got == {k: brute.more_secrets(text) for k, text in enumerate(texts)}
    assert {kind for spans in got.values() for _, kind, _ in spans} == brute.MORE_SECRETS.keys()


@pytest.mark.parametrize("piece", [40, chat_masks.PIECE_CHARS])
def test_blocks_of_a_long_conversation_are_the_tokens_of_the_whole(spark, monkeypatch, piece):
    monkeypatch.setattr(chat_masks, "PIECE_CHARS", piece)
    turns = [("assistant" if n % 2 else "user", f" turn {n} <|end|> é\n" * (n % 4)) for n in range(700)]
    rows = [(1, n, role, text) for n, (role, text) in enumerate(turns)]
    blocks = chat_masks.formatted_blocks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTES)
    pieces = sorted(blocks.collect(), key=lambda r: (r.block, r.piece))
    assert len(pieces) > 2
    text, spans = chat_masks.rendered(turns)
    whole = chat_masks.mark_tokenizer(BYTES).encode(text, add_special_tokens=False)
    masks = chat_masks.token_masks(np.array(whole.offsets).reshape(-1, 2), spans)
    assert "".join(p.formatted for p in pieces) == text
    assert [i for p in pieces for i in p.ids] == whole.ids
    shifted, tokens, chars = [], 0, 0
    for p in pieces:
        shifted += [(m.first_token + tokens, m.last_token + tokens, m.start + chars, m.stop + chars) for m in p.masks]
        tokens, chars = tokens + len(p.ids), chars + len(p.formatted)
    assert shifted == [(m["first_token"], m["last_token"], m["start"], m["stop"]) for m in masks]


def test_intermediate_tables_can_be_removed(spark, tmp_path):
    with shared.scratch(spark) as folder:
        kept = shared.written(spark.range(5), "five")
        assert kept.count() == 5 and folder in kept.inputFiles()[0]
        outside = spark.range(3).count()
    assert outside == 3
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(f"{folder}").count()
    again = shared.written(spark.range(2), "two")
    assert again.count() == 2 and folder not in again.inputFiles()[0]
