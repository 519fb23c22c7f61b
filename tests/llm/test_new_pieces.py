"""New pieces are encoded many at a time, to the ids that the library gives for the whole text."""

import numpy as np
import public_tokenizers

from tessera.llm.token_files import PieceCache


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode(self, text, **how):
        self.calls += 1
        return self.tokenizer.encode(text, **how)

    def encode_batch_fast(self, texts, **how):
        self.calls += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_new_pieces_share_calls():
    rng = np.random.default_rng(5)
    signs = [*"abcxyzéñü019 .,;:!?-(\n\t\r\v\f\x85\xa0\x1c\x00\xad²½", "  ", "\n\n", " \n"]
    texts = ["".join(rng.choice(signs, 60)) for _ in range(300)] + ["", "\n", " ", "a\n", "\na", "\r\n a"]
    cache = PieceCache(public_tokenizers.path("byte_bpe_50k.json"))
    want = [cache.whole(t) for t in texts]
    cache.tokenizer = Counting(cache.tokenizer)
    assert cache.encode(texts) == want
    assert len(cache.known) > 1000 and cache.tokenizer.calls < len(cache.known) / 3
