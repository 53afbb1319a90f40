"""The pass that signs texts does its work on many segments and texts at once, with the results of one at a time."""

import random

import numpy as np
import pyarrow as pa

from weirflow.llm import residue
from weirflow.llm.residue_notices import is_notice
from weirflow.llm.residue_text import kinds, masks, read

WORDS = "the river stone cloud no we la el der page 404 server not found session is your tree wind".split()
NOTICES = ["Access denied.", "Der Server ist derzeit nicht erreichbar.", "Le fichier demandé a été supprimée.", "Se ha producido un error.", "Etwas ist schiefgelaufen.", "This is sample text.", "Lorem ipsum dolor sit amet."]


def _signed(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [r for b in residue._sign(iter([batch, batch])) for r in b.to_pylist()]


def _texts():
    rnd = random.Random(5)
    begins = ["", "", "page not found ", "the server is ", "error 404 ", "your session has "]
    texts = [rnd.choice(begins) + " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([1, 3, 9, 40]))) + ".\nThen it rained." for _ in range(400)]
    return texts + NOTICES + [f'He said "{n[:-1]}" twice.' for n in NOTICES] + ["...", "0", "one", "- 12 -", "wide river " * 900, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(600))]


def test_p9_few_segments_are_matched_against_each_notice(monkeypatch):
    seen = []
    monkeypatch.setattr(residue, "is_notice", lambda tokens, segment: seen.append(segment) or is_notice(tokens, segment))
    content = [f"The river {chr(97 + i // 26)}{chr(97 + i % 26)}xo carries stone and cloud to the wind." for i in range(500)]
    got = _signed(content + NOTICES)
    assert [r["doc_id"] for r in got if r["trusted"]] == 2 * [500 + i for i in range(len(NOTICES))]
    assert len(seen) < 50


def test_p9_trusted_segments_and_signatures_are_those_of_one_at_a_time():
    texts = _texts()
    got = _signed(texts)
    assert len(got) == 2 * len(texts) and got[: len(texts)] == got[len(texts) :]
    some = 0
    for r, text in zip(got, texts):
        segments = read(text, masks(), kinds())
        trusted = dict.fromkeys(residue.hashed(t) for t, n, _ in segments if t and n and residue.is_seed(t))
        assert r["trusted"] == list(trusted)
        some += len(trusted)
        words = [w for _, _, tokens in segments for w in tokens] or [text]
        one = np.unique(residue.shingle_hashes(words, residue.word_hashes()))
        assert (r["sig"], r["turned"], r["mixed"], r["shingles"]) == (*residue.simhash(one), len(one))
    assert some > 50
