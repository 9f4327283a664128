"""Sequence models as scorers. Numpy works on one Arrow batch inside a task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from varimill.operators.scoring import OK, Outcome

SequenceModel = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class LstmModel:
    """Single-layer LSTM with a linear head on the last step, in the weights' precision.

    Weights follow the common layout: gate rows in the order input, forget,
    cell, output; ``w_ih`` is (4h, f), ``w_hh`` is (4h, h).
    """

    w_ih: np.ndarray
    w_hh: np.ndarray
    b_ih: np.ndarray
    b_hh: np.ndarray
    head_w: np.ndarray
    head_b: np.ndarray

    @classmethod
    def from_seed(
        cls, seed: int = 0, features: int = 3, hidden: int = 32, dtype: type = np.float32
    ) -> LstmModel:
        """Untrained weights, uniform within 1/sqrt(hidden)."""
        rng = np.random.default_rng(seed)
        bound = hidden**-0.5

        def draw(*shape: int) -> np.ndarray:
            return rng.uniform(-bound, bound, shape).astype(dtype)

        h4 = 4 * hidden
        return cls(draw(h4, features), draw(h4, hidden), draw(h4), draw(h4), draw(1, hidden), draw(1))

    @classmethod
    def from_npz(cls, path: str) -> LstmModel:
        """Trained weights, stored under the field names of this class."""
        with np.load(path) as z:
            return cls(**{k: z[k].astype(np.float32) for k in cls.__dataclass_fields__})

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(n, steps, features) to (n,)."""
        dtype = self.w_hh.dtype
        x = x.astype(dtype, copy=False)
        n, steps, _ = x.shape
        hidden = self.w_hh.shape[1]
        # The input half of all steps is one matrix product.
        pre = x @ self.w_ih.T + (self.b_ih + self.b_hh)
        h = np.zeros((n, hidden), dtype)
        c = np.zeros((n, hidden), dtype)
        for t in range(steps):
            i, f, g, o = np.split(pre[:, t] + h @ self.w_hh.T, 4, axis=1)
            c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
            h = _sigmoid(o) * np.tanh(c)
        return (h @ self.head_w.T + self.head_b)[:, 0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


@dataclass(frozen=True)
class SequenceScorer:
    """Scorer over local models; a slot without a model stays null.

    Requests whose sequence is shorter than ``length`` get no model output,
    which is not a failure: the linear forecast stands without it.
    """

    columns = ("sequence",)  # what it looks at

    lstm: SequenceModel | None = None
    mamba: SequenceModel | None = None
    length: int = 22

    def __call__(self, requests: pa.RecordBatch) -> Outcome:
        n = requests.num_rows
        sequences = requests.column("sequence")
        lengths = pc.fill_null(pc.list_value_length(sequences), 0).to_numpy(zero_copy_only=False)
        full = lengths >= self.length
        x = self._matrix(sequences.filter(pa.array(full)), lengths[full])

        def run(model: SequenceModel | None) -> np.ndarray:
            out = np.full(n, np.nan)
            if model is not None and len(x):
                out[full] = model(x)
            return out

        return Outcome(
            status=np.full(n, OK, dtype=object), mamba=run(self.mamba), lstm=run(self.lstm)
        )

    def _matrix(self, sequences: pa.ListArray, lengths: np.ndarray) -> np.ndarray:
        """(n, length, features) of the last ``length`` rows of each."""
        if not len(sequences):
            return np.zeros((0, self.length, 0))
        steps = sequences.flatten()
        if (lengths > self.length).any():
            ends = np.cumsum(lengths)
            last = ends[:, None] - np.arange(self.length, 0, -1)
            steps = steps.take(pa.array(last.ravel()))
        values = steps.flatten().to_numpy(zero_copy_only=False)
        return values.reshape(len(sequences), self.length, -1)
