"""Ids of odd characters against the library's own, over whole texts."""

import json
import random

from tokenizers import Tokenizer

from tessera.llm.queries import tokenizer_path
from tessera.llm.token_store import END_ID, Encoder

ODD = "abZ'sS''tTreLlVEmMdD0123.,-!<|>_ \t\n\x0b\xa0éÉßÿÞ×÷µªº¼²İΣ́—“日本😀\x85 ͅﬁ½"

PLAIN = "abZ'sS''tTreLlVEmMdD0123.,-!<>_ \t\n\x0b\x0c\réÉßÿÞ"


def test_ids_of_odd_texts():
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|>a", "x<|startoftext|> <|endoftext|", "DON'T we'LL", "a''s'T"]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(PLAIN) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    rng.shuffle(texts)
    encoder = Encoder(tokenizer_path())
    encoder.HELD = 500  # runs and pieces are forgotten on the way
    got = []
    for k in range(0, len(texts), 100):
        got += [x.tolist() for x in encoder.encode([x.encode() for x in texts[k : k + 100]])]
    want = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    assert got == [x.ids + [END_ID] for x in want]


def test_another_vocabulary_goes_to_the_library_whole(tmp_path):
    """The same file but for its normalizer: texts are not parted here."""
    said = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    said["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "Lowercase"}, {"type": "StripAccents"}]}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    texts = ["café élan", "", "plain words", "É" * 50]
    encoder = Encoder(str(path))
    got = [x.tolist() for x in encoder.encode([x.encode() for x in texts])]
    want = [[*Tokenizer.from_file(str(path)).encode(x, add_special_tokens=False).ids, END_ID] for x in texts]
    assert not encoder.parts and Encoder(tokenizer_path()).parts
    assert got == want
