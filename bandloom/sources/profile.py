"""Receiver settings from a YAML profile; what is given on the command line comes first.

A profile has a table ``receivers`` (one table of settings for each receiver), a table
``detection`` and a table ``operator``. A parked receiver has a ``center_hz``, a rotating one
(``mode: rotating``) a list of ``windows`` and a ``dwell_seconds``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import yaml


@dataclass(frozen=True)
class Window:
    center_hz: int
    label: str | None = None


@dataclass(frozen=True)
class Receiver:
    """Settings as a run uses them; the values here stand where the profile says nothing."""

    receiver_id: str
    windows: tuple[Window, ...]
    mode: str = "parked"
    dwell_seconds: float | None = None
    sample_rate: float = 10e6
    gain: float = 12.0
    ppm: float = 0.0
    serial: str | None = None
    attenuator_db: float | None = None
    antenna: str | None = None
    on_db: float = 10.0
    off_db: float = 6.0
    min_duration_s: float = 0.12
    hang_s: float = 0.30


NUMBERS = ("dwell_seconds", "sample_rate", "gain", "ppm", "on_db", "off_db", "min_duration_s", "hang_s")
DETECTION = ("on_db", "off_db", "min_duration_s", "hang_s")
NOT_ZERO = ("dwell_seconds", "sample_rate")  # 0 says nothing here; a gain of 0 is a gain


def _table(doc, name: str) -> dict:
    found = (doc or {}).get(name) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{name} is not a table of settings")
    return found


def _windows(own: dict, who: str) -> tuple[Window, ...]:
    if own.get("mode", "parked") == "rotating":
        listed = own.get("windows") or []
        if not listed:
            raise ValueError(f"receiver {who!r} is rotating but has no windows")
    else:
        if own.get("center_hz") is None:
            raise ValueError(f"receiver {who!r} is parked but has no center_hz")
        listed = [own]
    try:
        return tuple(Window(int(w["center_hz"]), w.get("label")) for w in listed)
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"receiver {who!r} needs a center_hz in every window") from e


def load(text: str, receiver_id: str) -> Receiver:
    """One receiver of a profile."""
    doc = yaml.safe_load(text)
    every = _table(doc, "receivers")
    if receiver_id not in every:
        raise ValueError(f"the profile has no receiver {receiver_id!r}; it has {sorted(every)}")
    own, det = _table(every, receiver_id), _table(doc, "detection")
    said = {f.name: (det if f.name in DETECTION else own).get(f.name) for f in fields(Receiver) if f.name not in ("receiver_id", "windows")}
    said = {k: float(v) if k in NUMBERS else v for k, v in said.items() if v is not None and not (k in NOT_ZERO and not v)}
    return Receiver(receiver_id, _windows(own, receiver_id), **said)


def resolved(r: Receiver, freq_hz: int | None = None, **given) -> Receiver:
    """Settings that were given replace the profile's; a frequency parks the receiver. Several windows need a dwell."""
    r = replace(r, **{k: v for k, v in given.items() if v is not None})
    r = r if freq_hz is None else replace(r, windows=(Window(int(freq_hz), "--freq"),), mode="parked")
    if len(r.windows) > 1 and not r.dwell_seconds:
        raise ValueError(f"receiver {r.receiver_id!r} has several windows and needs dwell_seconds")
    return r


def licences(text: str) -> tuple[str, ...]:
    return tuple(_table(yaml.safe_load(text), "operator").get("licences", ()))
