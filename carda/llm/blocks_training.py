"""Fit the block labeller: python -m carda.llm.blocks_training SF_DIR [PAGES].

Labels come from the jobs the pages belong to: a block is main text when it is the job's title, one of its data
lines, or a stretch of its description. At most PAGES pages (default 2,500, every ok page in id order) are used, a
tenth of them held out.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd

from carda.llm.blocks import DIM, HIDDEN, MODEL_FILE, Block, _SPACE, _sigmoid, features, inputs, leaf_blocks, lstm, new_model, predict


# Words that open the data lines of a posting.
DATA_LINES = ("薪资", "地区", "招聘方", "发布", "Salario", "Zona", "Empresa", "Publicado")


def labels(blocks: list[Block], job: dict) -> np.ndarray | None:
    """1 for blocks of the posting; None where the page does not show its job's text."""
    sq = lambda s: _SPACE.sub("", str(s)) if s is not None and s == s else ""
    title, desc = sq(job["title"]), sq(job["description"])
    y = np.zeros(len(blocks), np.float32)
    head = None
    for i, b in enumerate(blocks):
        s = b.squeezed
        if b.hidden:
            continue
        if s == title and b.linked < 0.9 and head is None:
            y[i], head = 1, i
        elif len(s) >= 5 and s in desc and b.linked < 0.9:
            y[i] = 1
        elif head is not None and i - head <= 7 and b.linked < 0.9:
            y[i] = float(s.startswith(DATA_LINES) and len(s) < 80)
    body = sum(len(b.squeezed) for b, k in zip(blocks, y) if k and b.squeezed in desc)
    return y if head is not None and desc and body >= 0.9 * len(desc) else None


def fit(pages: list[tuple[list[Block], np.ndarray]], epochs: int = 7, batch: int = 32, rate: float = 4e-3, seed: int = 3) -> dict[str, np.ndarray]:
    model = new_model()
    r = np.random.default_rng(seed)
    feats = [features(b) for b, _ in pages]
    mom = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items()}
    step = 0
    for epoch in range(epochs):
        order, loss_sum = r.permutation(len(pages)), 0.0
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            fs = [feats[i] for i in ids]
            x, mask = inputs(model, fs)
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(ids):
                y[k, : len(pages[i][1])] = pages[i][1]
            kf, kb = [], []
            fwd = lstm(x, mask, model["Wf"], model["cf"], kf)
            bwd_r = lstm(x[:, ::-1], mask[:, ::-1], model["Wb"], model["cb"], kb)
            top = np.concatenate([fwd, bwd_r[:, ::-1], x], axis=2)
            p = _sigmoid(top @ model["out"] + model["bias"])[..., 0]
            n = mask.sum()
            loss_sum += float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
            dz = (mask * (p - y) / n)[..., None]
            grad = {k: np.zeros_like(v) for k, v in model.items()}
            grad["out"] = top.reshape(-1, top.shape[2]).T @ dz.reshape(-1, 1)
            grad["bias"] = dz.sum(axis=(0, 1))
            dtop = dz @ model["out"].T
            dx = dtop[..., 2 * HIDDEN :].copy()
            dx += _back(x, kf, dtop[..., :HIDDEN], model["Wf"], grad, "f")
            dx += _back(x[:, ::-1], kb, dtop[..., HIDDEN : 2 * HIDDEN][:, ::-1], model["Wb"], grad, "b")[:, ::-1]
            for k, (paths, words, _) in enumerate(fs):
                m = len(words)
                np.add.at(grad["path"], paths, (dx[k, :m, :DIM] / 3)[:, None, :].repeat(3, axis=1))
                lens = np.asarray([len(w) for w in words])
                np.add.at(grad["word"], np.concatenate(words), np.repeat(dx[k, :m, DIM : 2 * DIM] / lens[:, None], lens, axis=0))
            step += 1
            for k in model:
                g = np.clip(grad[k], -1, 1)
                a, b = mom[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                model[k] -= (rate * 0.6**epoch if epoch > 2 else rate) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        print("epoch", epoch, "loss", round(loss_sum / max(1, len(order) // batch), 5), flush=True)
    return model


def _back(x: np.ndarray, kept: list, dout: np.ndarray, w: np.ndarray, grad: dict, way: str) -> np.ndarray:
    """Backpropagation through time of one direction; returns the gradient of its input."""
    n, steps, d = x.shape
    dh = np.zeros((n, HIDDEN), np.float32)
    dc = np.zeros((n, HIDDEN), np.float32)
    dx = np.zeros_like(x)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, k = kept[t]
        dh = dh + dout[:, t]
        dh2, pass_h = dh * k, dh * (1 - k)
        dc2 = dc * k + dh2 * o * (1 - tc * tc)
        dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
        grad[f"W{way}"][:d] += x[:, t].T @ dz
        grad[f"W{way}"][d:] += h.T @ dz
        grad[f"c{way}"] += dz.sum(axis=0)
        dx[:, t] = dz @ w[:d].T
        dh = pass_h + dz @ w[d:].T
        dc = dc * (1 - k) + dc2 * f
    return dx


def labelled_pages(sf_dir: str, limit: int) -> list[tuple[list[Block], np.ndarray]]:
    jobs = pd.read_parquet(f"{sf_dir}/jobs_clean.parquet", columns=["source_url", "title", "description"])
    by_url = {r["source_url"]: r for r in jobs.to_dict("records")}
    pages = pd.read_parquet(f"{sf_dir}/raw_pages.parquet").sort_values("id")
    out = []
    for r in pages[(pages.http_status == 200) & pages.raw_html.notna()].itertuples():
        if (job := by_url.get(r.source_url)) is not None and (b := leaf_blocks(r.raw_html)) and (y := labels(b, job)) is not None:
            out.append((b, y))
            if len(out) >= limit:
                break
    return out


def accuracy(model: dict, pages: list) -> tuple[float, float]:
    """Share of blocks, and of whole pages, labelled right."""
    probs = predict(model, [features(b) for b, _ in pages])
    right = [((p >= 0.5) == (y > 0.5)) for p, (_, y) in zip(probs, pages)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


def main(sf_dir: str, limit: int = 2500) -> None:
    pages = labelled_pages(sf_dir, limit)
    held = pages[::10]
    train = [p for i, p in enumerate(pages) if i % 10]
    print(len(train), "pages to fit,", len(held), "held out")
    model = fit(train)
    print("held out: blocks right %.5f, pages right %.4f" % accuracy(model, held))
    np.savez_compressed(MODEL_FILE, **{k: v.astype(np.float16) for k, v in model.items()})


if __name__ == "__main__":
    main(sys.argv[1], *(int(a) for a in sys.argv[2:3]))
