"""Plain pieces reach the tokenizers library's model without its pattern, with the same ids."""

import pyarrow as pa
from tokenizers import Tokenizer

from leasegrain.llm import token_files
from leasegrain.llm.queries import tokenizer_path

PLAIN = ["word", "word,", "Éa", "dueñas...", "quoted'", "a.\nB", "über,\nStraße)\nx", "ǆ!?", "it'\ns", "tick`~", "x" * 300]
OTHER = ["don't", "'s", "we're,", "7", "a7", "a,b", "a\n\nb", "a\n,b", "a\n", "naïve×", "日本", "ét", "a\tb", "a b", "`tick`~", "\x01", "a\x01b", "-", "a\x00", "ß͸", "\U0001f600"]


def test_plain_pieces_skip_the_pattern_and_keep_their_ids():
    library, encoder = Tokenizer.from_file(tokenizer_path()), token_files.Encoder(tokenizer_path(), known=60)
    lines, whole, plain = [], [], encoder.plain
    encoder.plain = lambda x: lines.extend(x.to_pylist()) or plain(x)
    encoder.whole = (lambda f: lambda x: whole.extend(x) or f(x))(encoder.whole)
    pieces = PLAIN + OTHER
    texts = ["start " + " ".join(pieces), *[f"{a} {b} end" for a in pieces for b in pieces], *pieces, " ".join(f"{p}{k}" for k in range(9) for p in PLAIN), None]
    for batch in (texts, texts[::-1], [" ".join(PLAIN * 90)]):
        lengths, ids = encoder(pa.array(batch, pa.string()))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in batch]
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    reached = {p for line in lines for p in line[1:].split(token_files.CUT + " ")}
    assert reached >= set(PLAIN) and not reached & set(OTHER)
    inner = {p for line in whole if line.startswith(" ") for p in line[1:].split(" ")}
    assert not inner & set(PLAIN)
