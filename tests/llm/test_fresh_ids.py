from types import SimpleNamespace

import numpy as np


def test_byte_level_pretokens_go_to_the_model():
    """Each pre-token's ids equal the library's, and it is not split and wrapped by the library again."""
    import public_tokenizers

    from verbaspark.llm import encoding

    ids = encoding.LibraryIds(public_tokenizers.path("byte_bpe_50k.json"), False)
    library = ids.library
    tokens = [" the", "'re", "  ", "\n\n", " Straße", "漢字", "́", "🙂🙂", " 1234567", "<|endoftext|>", "\x00\x7f\xad", "é" * 300, "qzxvkj" * 50]
    raw = [t.encode() for t in tokens]
    ids.library = SimpleNamespace(model=library.model)
    flat, counts = ids.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    expected = [[t.id for p, _ in library.pre_tokenizer.pre_tokenize_str(token) for t in library.model.tokenize(p)] for token in tokens]
    assert [library.encode(t, add_special_tokens=False).ids for t in tokens] == expected
    parts = np.split(flat, np.cumsum(counts)[:-1])
    single = [k for k, t in enumerate(tokens) if len(library.pre_tokenizer.pre_tokenize_str(t)) == 1]
    assert len(single) >= 9 and all(parts[k].tolist() == expected[k] for k in single)
