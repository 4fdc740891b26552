"""Chunks of the token encoder that are a word with marks behind it are known by their two parts."""

import public_tokenizers
from verseline.llm.tokenbin import ChunkEncoder


def test_marks_behind_a_word_are_asked_once():
    enc = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Rose### rose$$$ tree### tree$$$ a_b- don't's &&& <|endoftext|>a Él@", "rose### 10 É= x~"]
    ids, lengths = enc.encode(texts, 1)
    assert {"###", "$$$", "rose", "tree"} <= set(enc.known)
    want = [e.ids + [1] for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == list(map(len, want))
