"""How a batch's rows become one value. The first element decides; what does
not fit falls back to a list. Tensors are made where their library is there."""

from __future__ import annotations

from numbers import Number

import numpy as np

try:
    import torch
except ImportError:
    torch = None


def is_tensor(x: object) -> bool:
    return torch is not None and isinstance(x, torch.Tensor)


def _array(values: list, tensors: bool):
    if tensors and torch is not None:
        return torch.as_tensor(values)
    return np.array(values)


def _collate(batch, tensors: bool):
    again = lambda x: _collate(x, tensors)
    if isinstance(batch, dict):
        return {k: again(v) for k, v in batch.items()}
    if not isinstance(batch, (list, tuple)) or not len(batch):
        return batch
    first = batch[0]
    if isinstance(first, dict):
        return {k: again([row[k] for row in batch if k in row]) for k in first}
    if first is None or isinstance(first, (str, bytes)):
        return list(batch)
    try:
        if is_tensor(first):
            return torch.stack(list(batch)) if tensors else np.stack([x.numpy() for x in batch])
        if isinstance(first, np.ndarray):
            stacked = np.stack(batch)
            return torch.from_numpy(stacked) if tensors and torch is not None else stacked
        if isinstance(first, (Number, bool, np.generic)):
            if any(x is None for x in batch):
                return list(batch)
            return _array(list(batch), tensors)
        if isinstance(first, (list, tuple)):
            if len({len(x) for x in batch}) == 1 and len(first):
                if all(isinstance(y, Number) for x in batch for y in x):
                    return _array([list(x) for x in batch], tensors)
                return [again(list(column)) for column in zip(*batch, strict=True)]
    except (TypeError, ValueError, RuntimeError):
        pass
    return list(batch)


def default_collate(batch):
    return _collate(batch, True)


def numpy_collate(batch):
    return _collate(batch, False)


def pin(batch):
    """Page-locked copies of tensors; other values as they are."""
    if is_tensor(batch):
        return batch.pin_memory()
    if isinstance(batch, dict):
        return {k: pin(v) for k, v in batch.items()}
    return [pin(v) for v in batch] if isinstance(batch, list) else batch


COLLATE = {None: default_collate, "default": default_collate, "numpy": numpy_collate}
