import json
from types import SimpleNamespace

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidescan.llm import packing

TEXTS = ["Évièelle straße, ÀÉÎÕÜŸ ÿþ÷×ª naïvE's", "THE end. the-End µm été ΣΑΣ ŉ 12a <|endoftext|>b", None, "", " ".join(x + y + z for x in packing._LETTERS for y, z in ("ae", "Zq"))]


def ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids], "<u4").tobytes()


def test_new_runs_of_latin_letters_go_to_the_model_alone(monkeypatch):
    """They took all steps of the tokenizer, one run at a time, which was most of op5_packing's CPU."""
    words, asked = packing.Words(open(packing.default_tokenizer()).read(), 1000), []
    own = words.tokenizer
    words.tokenizer = SimpleNamespace(encode=own.encode, encode_batch_fast=lambda runs, **k: asked.extend(runs) or own.encode_batch_fast(runs, **k))
    for _ in range(2):
        assert words.encode(TEXTS) == [ids(own, t) for t in TEXTS]
    assert asked and not any(r.isascii() and r.isalpha() for r in asked) and "Évièelle" not in asked and "straße" not in asked


@pytest.mark.parametrize("change", ["cased", "added", "accents"])
def test_other_tokenizers_keep_their_own_steps(change):
    spec = json.loads(open(packing.default_tokenizer()).read())
    if change == "cased":
        spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    elif change == "accents":
        spec["normalizer"]["normalizers"] += [{"type": "NFD"}, {"type": "StripAccents"}]
    else:
        spec["added_tokens"].append({**spec["added_tokens"][0], "id": 49408, "content": "end", "special": False})
    words, own = packing.Words(json.dumps(spec), 1000), Tokenizer.from_str(json.dumps(spec))
    assert words.encode(TEXTS) == [ids(own, t) for t in TEXTS] and not words.latin


def test_remembered_keys_return_from_the_old_generation():
    memo = packing.Memo(1)
    memo.update({1: b"a", 2: b"b"})
    memo.turn()
    assert memo.lacks([1, 3]) == [3] and memo == {1: b"a"} and memo.old == {1: b"a", 2: b"b"}
