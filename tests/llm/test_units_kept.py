import public_tokenizers

from loomspace.llm import token_align


def test_a_task_learns_a_unit_once(monkeypatch):
    """A task's share of usual documents holds over 500,000 different units: none of them is learnt twice."""
    learnt, learn = [], token_align.Aligner.learn
    monkeypatch.setattr(token_align.Aligner, "learn", lambda self, fresh: (learnt.append(len(fresh)), learn(self, fresh)))
    aligner = token_align.Aligner(token_align.ByteTokens(public_tokenizers.path("byte_bpe_50k.json")), token_align.PieceTokens(public_tokenizers.path("piece_bpe_32k.model")))
    texts = [" ".join(f"{c}{i}" for i in range(160_000)) for c in "ab"]
    first = [aligner.align([t])[0] for t in texts]
    assert [aligner.align([t])[0] for t in texts] == first and first[0][0][0] > 0
    assert sum(learnt) == 320_000
