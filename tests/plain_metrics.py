"""Plain metrics of class probabilities, on numpy alone."""

import numpy as np


def accuracy(p, y):
    return float((p.argmax(axis=1) == y).mean())


def log_loss(p, y):
    return float(-np.log(p[np.arange(len(y)), y]).mean())


def f1_weighted(p, y):
    said, total = p.argmax(axis=1), 0.0
    for c in set(y.tolist()) | set(said.tolist()):
        hit = ((said == c) & (y == c)).sum()
        total += (y == c).sum() * (2 * hit / ((said == c).sum() + (y == c).sum()))
    return float(total / len(y))


def auc(p, y):
    a, b = p[y == 1, 1], p[y == 0, 1]
    return float(((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)))
