"""Where models run."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any


def _torch_has(place: str) -> bool:
    try:
        import torch
    except ImportError:
        return False
    module = getattr(torch, "cuda", None) if place == "cuda" else getattr(getattr(torch, "backends", None), "mps", None)
    return bool(module is not None and getattr(module, "is_available", lambda: False)())


def resolve_device(preference: str = "auto", allow_mps: bool = True) -> str:
    """cuda, mps or cpu: the one preferred if there is one, by default the first there is."""
    order = {"cuda": ("cuda",), "mps": ("mps",), "cpu": ()}.get(preference, ("cuda", "mps") if allow_mps else ("cuda",))
    return next((d for d in order if _torch_has(d)), "cpu")


def model_device(model: Any) -> Any:
    """Where a loaded model is: its own word, else its first parameter's; None if neither tells."""
    place = getattr(model, "device", None)
    if place is None and hasattr(model, "parameters"):
        place = getattr(next(iter(model.parameters()), None), "device", None)
    return place


@contextmanager
def without_mps(device: Any) -> Iterator[None]:
    """While a model that is elsewhere runs, torch says that it has no mps: some models ask and then break."""
    try:
        import torch
    except ImportError:
        torch = None
    if torch is None or getattr(device, "type", str(device or "cpu")) == "mps":
        yield
        return
    places = [m for m in (getattr(torch, "mps", None), getattr(getattr(torch, "backends", None), "mps", None)) if m is not None]
    kept = [(m, vars(m).get("is_available")) for m in places]
    for m in places:
        m.is_available = lambda: False
    try:
        yield
    finally:
        for m, own in kept:
            if own is None:
                del m.is_available
            else:
                m.is_available = own


def device_to_device_map(device: str) -> str:
    """As model loaders want it: mps is left to them."""
    return "auto" if device == "mps" else device
