"""Helpers of these tests."""

import os
import zlib

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def auc(truth, score):
    import pandas as pd

    r, t = pd.Series(list(score)).rank(), pd.Series(list(truth))
    n1 = int((t == 1).sum())
    n0 = len(t) - n1
    return (r[t == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
