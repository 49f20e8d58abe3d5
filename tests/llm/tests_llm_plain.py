"""Plain versions shared by the corpus tests."""

import re
import zlib

import numpy as np
import public_tokenizers as P

_CAPITALS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ")


def plain_rules(text):
    """Whether a text passes every rule."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(w), sum(map(len, w))
    windows = {}
    for i in range(n - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    fails = (
        n < 20 or 100 * covered > 30 * n or 100 * sum(text.count(c) for c in "#*$%&|<>") > 8 * chars
        or len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        or 100 * sum(c in _CAPITALS for c in text) > 40 * chars or chars < 2 * n or chars > 25 * n
        or 100 * text.count("!") > 30 * n or 100 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 30 * n
    )
    return not fails


def brute_suffix(docs, length=200):
    """id -> text without the bytes of repeated strings; characters cut in part go."""
    seen = {}
    for d, t in docs:
        b = t.encode()
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = {d: np.zeros(len(t.encode()) + 1, bool) for d, t in docs}
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = True
    out = {}
    for d, t in docs:
        b, pieces = t.encode(), []
        edges = np.flatnonzero(np.diff(gone[d].astype(int)))
        bounds = [0, *(edges + 1).tolist(), len(b)]
        for a, z in zip(bounds, bounds[1:], strict=False):
            if a < z and not gone[d][a]:
                pieces.append(b[a:z].decode("utf-8", "ignore"))
        out[d] = "".join(pieces)
    return out


def check_packed(rows, texts, width=1024):
    """Every id of every document lies in one piece, sequences are gapless, and all but one are full."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: [*e.ids, 0] for (d, _), e in zip(texts, t.encode_batch([x or "" for _, x in texts], add_special_tokens=False), strict=True)}
    at, sequences = {d: 0 for d in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at[d] == len(own) for d, own in ids.items())
    sizes = []
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        sizes.append(end)
    assert max(sizes, default=0) <= width and sum(s < width for s in sizes) <= 1 and sorted(sequences) == list(range(len(sequences)))
