"""Independent numpy statement of the frame coder, for cross-checks."""

import math

import numpy as np


def taper(w):
    return np.array([math.sin(math.pi * i / (w - 1.0)) ** 2 for i in range(w)])


def encode_frame(frame, centers, w, mode="centered"):
    """Returns (codes, coded, loss, score) for one frame and a (k, w) codebook."""
    frame = np.asarray(frame, dtype=float)
    n = len(frame) // w
    h = w // 2
    t = taper(w)
    codes, chosen, avgs, nrms, tnrms = [], [], [], [], []
    for k in range(2 * n - 1):
        x = frame[k * h:k * h + w]
        avg = x.sum() / w
        nrm = math.sqrt((x * x).sum())
        tx = x * t
        tn = math.sqrt((tx * tx).sum())
        if mode == "centered":
            f = None if nrm == 0 else (x - avg) / nrm * t
        else:
            f = None if tn == 0 else tx / tn
        avgs.append(avg); nrms.append(nrm); tnrms.append(tn)
        if f is None or centers is None or len(centers) == 0:
            codes.append(None); chosen.append(np.zeros(w)); continue
        d = ((centers - f) ** 2).sum(axis=1)
        c = int(np.argmin(d))           # first minimum = lowest code on ties
        codes.append(c); chosen.append(centers[c])
    coded = []
    for j in range(1, 2 * n - 1):
        a, b = chosen[j - 1][h:], chosen[j][:h]
        if mode == "centered":
            coded.extend((a + b) * nrms[j] + avgs[j])
        else:
            coded.extend(a * tnrms[j - 1] + b * tnrms[j])
    coded = np.array(coded)
    src = frame[h:len(frame) - h]
    loss = src - coded
    return codes, coded, loss, float(np.abs(loss).max()) if len(loss) else None
