"""Tokens and templates of many texts at once are those of each text alone."""

import numpy as np
import pyarrow as pa

from leasegrain.llm import decontamination

TEXTS = [
    "In Paris 12,5 kg were sold. He saw Six men over 3 days",
    None,
    "",
    "Most Words Have Capitals In This One",
    "\n\n",
    "ends in a Name\n",
    "Éa Straße, über 7 mm\nof Rain 5 5 7:30",
    "7",
    "7 mm of Rain in Paris and five more words that are plain",
]


def views(tokens):
    return tokens.template(), tokens.template(names=False), tokens.literal()


def test_texts_of_a_batch_are_read_at_once_and_stay_apart(monkeypatch):
    calls, plain = [], decontamination.token_hashes
    monkeypatch.setattr(decontamination, "token_hashes", lambda *a: calls.append(1) or plain(*a))
    together = decontamination.Tokens(pa.array(TEXTS, pa.string()))
    assert len(calls) == 1
    alone = [decontamination.Tokens(pa.array([t], pa.string())) for t in TEXTS]
    assert together.names.tolist() == [x.names[0] for x in alone] and together.capital.tolist() == [x.capital[0] for x in alone]
    for k, view in enumerate(views(together)):
        for size in (1, 3, 5):
            hashes, enough = view.windows(size)
            got, want = [], []
            for at in np.flatnonzero(enough).tolist():
                text = int(view.text[at])
                got.append((text, at - int(np.searchsorted(view.text, text)), int(hashes[at]), view.slots(at, size)))
            for text, one in enumerate(alone):
                own = views(one)[k]
                hashes, enough = own.windows(size)
                want += [(text, at, int(hashes[at]), own.slots(at, size)) for at in np.flatnonzero(enough).tolist()]
            assert got == want and len(want) > 5


def test_held_windows_are_those_of_each_text():
    sizes, marks = {decontamination.TYPED: [2, 5], decontamination.CAPITAL: [5], decontamination.LITERAL: [3]}, np.full(1 << 13, 255, np.uint8)
    batch = lambda ids: pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(ids, pa.int64()), "text_key": pa.array(ids, pa.int64()), "text": pa.array([TEXTS[k] for k in ids], pa.string())}
    )
    rows = lambda found: sorted((tuple(r.values()) for x in found for r in x.to_pylist()), key=repr)
    ids = list(range(len(TEXTS)))
    apart = [x for k in ids for x in decontamination._held(batch([k]), marks, sizes)]
    got = rows(decontamination._held(batch(ids), marks, sizes))
    assert got == rows(apart) and {r[2] for r in got} == {decontamination.TYPED, decontamination.NAMELESS, decontamination.LITERAL}
