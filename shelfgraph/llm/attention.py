"""A causal self-attention model over subword ids, trained and applied in numpy.

Ids are spread over classes of about equal frequency; the frequent ids are classes of their own. The
model predicts the class from the ids before it, and the id within its class by its corpus frequency, so
the product is a distribution over all ids. One attention head: the query of the last input's class meets the
keys of the classes before it, and each place has a weight of its own. What a key brings is a distribution
over the next class, counted over all texts for its distance, and attention mixes these; so a target's
probability is looked up, and no distribution is computed whole. A window holds WINDOW inputs; its last
BLOCK are scored, the others are context. Windows overlap so that each id is scored exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 32
BLOCK = 16
WIDTH = 16
CLASSES = 256
SINGLE = 160
STEPS = 400
BATCH = 512
RATE = 0.01
PASS_RATE = 0.003  # of the pass over all windows
LEAST_STEPS = 100  # of a pass; few windows are passed over again
PART = 128  # windows whose gradient is taken, or that are scored, at once
GROUPS = 3  # distances with values of their own: the last input, the one before it, all earlier ones
FAR = 4  # distances up to here are counted; the last group's values are those of its nearest ones
LEAST = -20.0  # of a class's attention logits, below its highest
RECENT = 0.25  # what each step back costs a key before training
PRIOR = 20.0  # weight of the classes' frequencies in the counted values
FOLLOWERS = (GROUPS, CLASSES + 2, CLASSES)  # shape of followers()
AWAY = np.arange(BLOCK)[:, None] + WINDOW - BLOCK - np.arange(WINDOW)[None, :]
#: Which keys a query may see: those up to its own input.
SEEN = AWAY >= 0
CAUSAL = np.where(SEEN, 0.0, -1e9).astype(np.float32)
#: Where the values of each query's keys start, in rows of classes.
GROUP = np.clip(AWAY, 0, GROUPS - 1) * (CLASSES + 2)


@dataclass
class Model:
    kind: np.ndarray  # class of each id; the last id is the end
    inner: np.ndarray  # log probability of each id within its class
    weights: dict[str, np.ndarray]

    @property
    def end(self) -> int:
        return len(self.kind) - 1


def classify(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of ids by frequency and the smoothed log probability of each id in its class."""
    order = np.argsort(-counts, kind="stable")
    kind = np.zeros(len(counts), np.int64)
    kind[order[:SINGLE]] = np.arange(min(SINGLE, len(order)))
    rest = order[SINGLE:]
    mass = np.cumsum(counts[rest] + 1.0)
    groups = CLASSES - SINGLE
    kind[rest] = SINGLE + np.minimum((mass - counts[rest] - 1.0) * groups // max(mass[-1], 1.0) if len(rest) else mass, groups - 1).astype(np.int64)
    smooth = counts + 1.0
    whole = np.bincount(kind, smooth, minlength=CLASSES)
    return kind, np.log(smooth / whole[kind])


def windows(ids: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (windows, WINDOW) as classes, targets (windows, BLOCK) as places in the extended id array,
    the extended ids (each text with the end id), and the text of each window.

    CLASSES is the start mark, CLASSES + 1 stands before it; a target of -1 is padding.
    """
    n = np.diff(bounds) + 1
    first = bounds[:-1] + np.arange(len(n))
    full = np.empty(len(ids) + len(n), np.int64)
    ends = first + n - 1
    body = np.ones(len(full), bool)
    body[ends] = False
    full[body] = ids
    full[ends] = len(kind) - 1
    count = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), count)
    start = np.repeat(first, count) + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    target = start[:, None] + np.arange(BLOCK)
    target = np.where(target < (first + n)[text][:, None], target, -1)
    # the input before a target predicts it, so a text's inputs are its marks, its ids and filling; windows are slices of these
    early = WINDOW - BLOCK
    begin = first + WINDOW * np.arange(len(n))
    line = np.zeros(len(full) + WINDOW * (len(n) + 1), np.int64)
    line[(begin[:, None] + np.arange(early)).reshape(-1)] = CLASSES + 1
    line[begin + early] = CLASSES
    line[np.arange(len(full)) + np.repeat(WINDOW * np.arange(len(n)) + early + 1, n)] = kind[full]
    inputs = np.lib.stride_tricks.sliding_window_view(line, WINDOW)[start + WINDOW * text]
    return inputs, target, full, text


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def forward(w: dict[str, np.ndarray], inputs: np.ndarray):
    """Log probabilities (windows * BLOCK, CLASSES) of all classes at the scored positions, and the attention. Plain, to check _ahead() against."""
    scores = w["query"][inputs[:, WINDOW - BLOCK :]] @ w["key"][inputs].transpose(0, 2, 1) + w["place"] + CAUSAL
    attention = _softmax(scores + np.where(inputs == CLASSES + 1, np.float32(-1e9), np.float32(0))[:, None, :])
    values = _softmax(w["value"].copy())
    mixed = sum((attention * (GROUP == n * (CLASSES + 2))) @ values[n][inputs] for n in range(GROUPS))
    return np.log(mixed).reshape(-1, CLASSES), attention


def _values(w: dict[str, np.ndarray]) -> np.ndarray:
    return _softmax(w["value"].copy()).reshape(-1)


def _tables(w: dict[str, np.ndarray], values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention of every class to every class, of every place, and the values, each as it is multiplied.

    A key that a query all but ignores keeps exp(LEAST) of that query's strongest, so that no sum is ever 0.
    """
    content = w["query"] @ w["key"].T
    content -= content.max(axis=1, keepdims=True)
    np.exp(np.maximum(content, LEAST, out=content), out=content)
    content[:, CLASSES + 1] = 0
    return content.reshape(-1), np.exp(w["place"]) * SEEN, _values(w) if values is None else values


def _ahead(tables, inputs: np.ndarray, kinds: np.ndarray):
    """Of each target (windows, BLOCK): attention to each input before it is scaled, that times the target's probability by the input, and where both were looked up."""
    content, place, values = tables
    met = (inputs[:, WINDOW - BLOCK :] * (CLASSES + 2))[:, :, None] + inputs[:, None, :]
    weight = np.take(content, met)
    weight *= place
    told = (GROUP * CLASSES + kinds[:, :, None]) + (inputs * CLASSES)[:, None, :]
    hit = np.take(values, told)
    hit *= weight
    return weight, hit, met, told


def _sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[-1], x.dtype)


def _logits(w, tables, inputs: np.ndarray) -> np.ndarray:
    """What forward() gives, by lookups."""
    out = []
    for kind in range(CLASSES):
        weight, hit, _, _ = _ahead(tables, inputs, np.full((len(inputs), BLOCK), kind))
        out.append(np.log(_sums(hit) / _sums(weight)).reshape(-1))
    return np.stack(out, axis=1)


def gradient(w, inputs, kinds, valid, values=None):
    """Mean loss over valid targets and its gradient. With values given, those of w are not learnt.

    What an input brings depends on classes and places alone, so slopes are added up by pairs of classes and by places before they meet the weights.
    """
    tables = _tables(w, values)
    kinds, valid = kinds.reshape(-1, BLOCK), valid.reshape(-1, BLOCK)
    total = np.float32(max(1.0, float(valid.sum())))
    loss, by_pair, place, share = 0.0, np.zeros((CLASSES + 2) ** 2), np.zeros((BLOCK, WINDOW)), np.zeros(w["value"].size)
    for lo in range(0, len(inputs), PART):
        own = valid[lo : lo + PART] / total
        weight, hit, met, told = _ahead(tables, inputs[lo : lo + PART], kinds[lo : lo + PART])
        whole, right = _sums(weight), _sums(hit)
        loss += float((own * np.log(whole / right)).sum())
        hit *= (own / right)[:, :, None]
        if values is None:
            share += np.bincount(told.reshape(-1), hit.reshape(-1), minlength=len(share))
        weight *= (own / whole)[:, :, None]
        weight -= hit
        by_pair += np.bincount(met.reshape(-1), weight.reshape(-1), minlength=len(by_pair))
        place += weight.sum(axis=0)
    by_pair = by_pair.reshape(CLASSES + 2, CLASSES + 2).astype(np.float32)
    g = {"query": by_pair @ w["key"], "key": by_pair.T @ w["query"], "place": place.astype(np.float32)}
    if values is None:
        share = share.reshape(w["value"].shape)
        g["value"] = (tables[2].reshape(share.shape) * share.sum(axis=-1, keepdims=True) - share).astype(np.float32)
    return loss, g


def fresh_weights(kind_counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    share = (kind_counts + 1.0) / (kind_counts + 1.0).sum()
    return {
        "query": draw(CLASSES + 2, WIDTH), "key": draw(CLASSES + 2, WIDTH), "place": np.where(SEEN, -RECENT * AWAY, 0).astype(np.float32),
        "value": np.tile(np.log(share).astype(np.float32), (GROUPS, CLASSES + 2, 1)),
    }


def followers(ids: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How often each class follows each class (and the start mark) of the texts, by group of distances."""
    n = np.diff(bounds) + 1
    line = np.full(len(ids) + 2 * len(n), CLASSES, np.int64)
    ends = np.cumsum(n + 1) - 1
    body = np.ones(len(line), bool)
    body[ends] = body[ends - n] = False
    line[body], line[ends] = kind[ids], kind[-1]
    text = np.repeat(np.arange(len(n)), n + 1)
    out = np.zeros(FOLLOWERS, np.int64).reshape(GROUPS, -1)
    for away in range(min(FAR, max(0, len(line) - 1))):
        before, after = line[: -1 - away], line[1 + away :]
        inside = text[: -1 - away] == text[1 + away :]
        out[min(away, GROUPS - 1)] += np.bincount((before * CLASSES + after)[inside], minlength=out.shape[1])
    return out.reshape(FOLLOWERS)


def counted_values(counts: np.ndarray, kind_counts: np.ndarray) -> np.ndarray:
    """Log probabilities of what follows, from followers() and the frequencies of the classes."""
    share = (kind_counts + 1.0) / (kind_counts + 1.0).sum()
    return np.log((counts + PRIOR * share) / (counts.sum(axis=-1, keepdims=True) + PRIOR)).astype(np.float32)


def fit(counts: np.ndarray, sample: list[np.ndarray], steps: int = STEPS, follow: np.ndarray | None = None) -> Model:
    """counts: of every id over the corpus, the end last. sample: ids of some texts, to start the weights on. follow: followers() of the corpus, else of the sample."""
    kind, inner = classify(counts.astype(float))
    kind_counts = np.bincount(kind, counts, minlength=CLASSES)
    w = fresh_weights(kind_counts)
    model = Model(kind, inner, w)
    bounds = np.append(0, np.cumsum([len(s) for s in sample])).astype(np.int64)
    ids = np.concatenate([*sample, np.zeros(0, np.int64)]).astype(np.int64)
    w["value"] = counted_values(followers(ids, bounds, kind) if follow is None else follow, kind_counts)
    if not sample:
        return model
    inputs, target, full, _ = windows(ids, bounds, kind)
    rng = np.random.default_rng(5)
    picks = (rng.integers(0, len(inputs), min(BATCH, len(inputs))) for _ in range(steps))
    rates = [RATE * min(1.0, step / 20) * (1 - 0.9 * step / steps) for step in range(1, steps + 1)]
    _descend(w, inputs, target, full, kind, picks, rates)
    return model


def _descend(w, inputs, target, full, kind, picks, rates) -> None:
    """Change the weights of the attention by one Adam step on each of the picked batches; the values stay as counted."""
    values = _values(w)
    learnt = [name for name in w if name != "value"]
    first, second = {k: np.zeros_like(w[k]) for k in learnt}, {k: np.zeros_like(w[k]) for k in learnt}
    kinds, valid = kind[full[np.maximum(target, 0)]], (target >= 0).astype(np.float32)
    for step, (pick, rate) in enumerate(zip(picks, rates, strict=True), 1):
        _, g = gradient(w, inputs[pick], kinds[pick], valid[pick], values)
        for name in learnt:
            first[name] += 0.1 * (g[name] - first[name])
            second[name] += 0.01 * (g[name] ** 2 - second[name])
            w[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def learnt(model: Model, ids: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """Weights after a pass over every window of the texts, from those of the model; and the number of windows."""
    w = {name: value.copy() for name, value in model.weights.items()}
    inputs, target, full, _ = windows(ids, bounds, model.kind)
    rng = np.random.default_rng(len(inputs))
    picks = []
    while len(inputs) and len(picks) < LEAST_STEPS:
        order = rng.permutation(len(inputs))
        picks += [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
    _descend(w, inputs, target, full, model.kind, picks, [PASS_RATE * min(1.0, (n + 1) / 20) for n in range(len(picks))])
    return w, len(inputs)


def log10_probabilities(model: Model, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each text, its end included."""
    inputs, target, full, text = windows(ids, bounds, model.kind)
    tables = _tables(model.weights)
    value = np.zeros(len(inputs))
    for lo in range(0, len(inputs), PART):
        goal = target[lo : lo + PART]
        own = full[np.maximum(goal, 0)]
        weight, hit, _, _ = _ahead(tables, inputs[lo : lo + PART], model.kind[own])
        value[lo : lo + PART] = np.where(goal >= 0, np.log(_sums(hit) / _sums(weight)) + model.inner[own], 0.0).sum(axis=1)
    return np.bincount(text, value, minlength=len(bounds) - 1) / np.log(10.0)
