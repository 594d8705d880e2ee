"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words, each a learned vector of its own beside the mean of the vectors of its character
trigrams; a window of words gives one logit. Arrays are float32 throughout.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 8
WORD_DIM = 8
CHAR_DIM = 8
CHAR_BUCKETS = 4096
ATTENTION = 8
WINDOW = 32
STRIDE = 16

Params = dict[str, np.ndarray]
_SEPARATORS = bytes(b if chr(b).isalnum() or b >= 128 or b == 39 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(n_words: int, seed: int = 7) -> Params:
    """Parameters before training; row 0 of the words is for unknown ones."""
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    params = {
        "words": normal(n_words + 1, WORD_DIM, scale=0.05),
        "chars": normal(CHAR_BUCKETS, CHAR_DIM, scale=0.05),
        "att_w": normal(2 * h, ATTENTION, scale=0.5),
        "att_b": np.zeros(ATTENTION, np.float32),
        "att_v": normal(ATTENTION, scale=0.5),
        "out_w": normal(2 * h, scale=0.5),
        "out_b": np.zeros(1, np.float32),
    }
    for side in ("f", "b"):
        params[f"in_{side}"] = normal(d, 3 * h, scale=d**-0.5)
        params[f"rec_{side}"] = normal(h, 3 * h, scale=h**-0.5)
        params[f"bias_{side}"] = np.zeros(3 * h, np.float32)
    params["words"][0] = 0
    return params


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character trigram of the words, their ends marked, and where each word's begin."""
    joined = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    codes = joined[:-2] * 961 + joined[1:-1] * 31 + joined[2:]
    buckets = codes * 2654435761 % (1 << 32) // ((1 << 32) // CHAR_BUCKETS)
    inside = np.ones(len(joined), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return buckets[inside[:-2]], np.concatenate([[0], np.cumsum(sizes - 2)])[:-1]


def embed(params: Params, words: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Input vectors of distinct words with the given rows in the word table; words are not empty."""
    if not words:
        return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
    buckets, starts = trigrams(words)
    counts = np.diff(np.append(starts, len(buckets)))[:, None]
    chars = np.add.reduceat(params["chars"][buckets], starts, axis=0) / counts
    return np.concatenate([params["words"][ids], chars], axis=1).astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words one after another: first word, length and text of each window.

    Windows of ``WINDOW`` words start every ``STRIDE`` words until one reaches the end; a text
    without words has none.
    """
    per_text = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(lengths)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begins = np.cumsum(lengths) - lengths
    size = np.minimum(WINDOW, lengths[text] - nth * STRIDE)
    return begins[text] + nth * STRIDE, size, text


def places(first: np.ndarray, size: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of each step of each window, and a mask of the steps that exist."""
    steps = np.arange(WINDOW)
    mask = steps < size[:, None]
    at = np.minimum(first[:, None] + steps, len(words) - 1)
    return words[at], mask


def forward(
    params: Params, projected: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: list | None = None
) -> np.ndarray:
    """Logit of each window; with ``keep``, what the way back needs is appended to it.

    ``projected`` holds, per direction, the input part of the gates of each distinct word.
    """
    n, h = len(at), HIDDEN
    states = np.empty((n, WINDOW, 2 * h), np.float32)
    whole = mask.all(axis=0)
    for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        rec, table, state = params[f"rec_{side}"], projected[side], np.zeros((n, h), np.float32)
        into = slice(0, h) if side == "f" else slice(h, 2 * h)
        for t in order:
            gates, own = table[at[:, t]], state @ rec
            both = sigmoid(gates[:, : 2 * h] + own[:, : 2 * h])
            new = np.tanh(gates[:, 2 * h :] + both[:, h:] * own[:, 2 * h :])
            after = new + both[:, :h] * (state - new)
            if not whole[t]:
                after = np.where(mask[:, t, None], after, state)
            if keep is not None:
                keep.append((side, t, state, both, new, own[:, 2 * h :]))
            state = after
            states[:, t, into] = state
    looked = np.tanh(states @ params["att_w"] + params["att_b"])
    weights = np.where(mask, looked @ params["att_v"], -1e9)
    weights = np.exp(weights - weights.max(axis=1, keepdims=True))
    weights /= weights.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", weights, states)
    if keep is not None:
        keep.append((states, looked, weights, pooled))
    return pooled @ params["out_w"] + params["out_b"][0]


def backward(
    params: Params, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list, of_logit: np.ndarray
) -> tuple[Params, np.ndarray]:
    """Gradients of all parameters but the tables, and of the input vectors of the distinct words."""
    h = HIDDEN
    states, looked, weights, pooled = keep.pop()
    grads: Params = {"out_w": pooled.T @ of_logit, "out_b": of_logit.sum(keepdims=True)}
    of_pooled = of_logit[:, None] * params["out_w"]
    of_weights = np.einsum("nh,nth->nt", of_pooled, states)
    of_scores = weights * (of_weights - (weights * of_weights).sum(axis=1, keepdims=True))
    grads["att_v"] = np.einsum("nt,ntk->k", of_scores, looked)
    of_looked = of_scores[:, :, None] * params["att_v"] * (1 - looked**2)
    grads["att_w"] = np.einsum("nth,ntk->hk", states, of_looked)
    grads["att_b"] = of_looked.sum(axis=(0, 1))
    of_states = weights[:, :, None] * of_pooled[:, None, :] + of_looked @ params["att_w"].T
    of_vectors = np.zeros_like(vectors)
    for side in ("b", "f"):
        rec = params[f"rec_{side}"]
        of_rec, of_gates = np.zeros_like(rec), np.zeros((len(vectors), 3 * h), np.float32)
        into = slice(0, h) if side == "f" else slice(h, 2 * h)
        carried = np.zeros((len(at), h), np.float32)
        for _ in range(WINDOW):
            _, t, state, both, new, own = keep.pop()
            of_after = carried + of_states[:, t, into]
            here = np.where(mask[:, t, None], of_after, 0)
            z, r = both[:, :h], both[:, h:]
            of_new = here * (1 - z) * (1 - new**2)
            of_z = here * (state - new) * z * (1 - z)
            of_r = of_new * own * r * (1 - r)
            of_in = np.concatenate([of_z, of_r, of_new], axis=1)
            of_own = np.concatenate([of_z, of_r, of_new * r], axis=1)
            np.add.at(of_gates, at[:, t], of_in)
            of_rec += state.T @ of_own
            carried = of_after - here + here * z + of_own @ rec.T
        grads[f"rec_{side}"] = of_rec
        grads[f"in_{side}"] = vectors.T @ of_gates
        grads[f"bias_{side}"] = of_gates.sum(axis=0)
        of_vectors += of_gates @ params[f"in_{side}"].T
    return grads, of_vectors


def project(params: Params, vectors: np.ndarray) -> dict[str, np.ndarray]:
    return {side: vectors @ params[f"in_{side}"] + params[f"bias_{side}"] for side in ("f", "b")}
