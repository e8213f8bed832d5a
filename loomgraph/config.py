"""Settings: defaults, overlaid by a .env file, overlaid by the environment."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping

PREFIX = "LOOMGRAPH_"
DEFAULTS = {
    "llm": {
        "base_url": "http://localhost:8080/v1", "chat_model": "mock", "embed_model": "", "api_key": "", "embed_base_url": "", "embed_api_key": "",
        "temperature": 0.0, "max_tokens": 0, "timeout": 300.0, "extra_body": {}, "report_model": "", "report_timeout": 2400.0, "report_extra_body": {},
    },
    "literature": {"base_url": "", "email": "", "key": "", "seed_results": 20, "expand_results": 10, "full_text": True},
    "tree": {"leaf_chars": 1200, "group_chars": 3500, "max_paragraphs": 500},
    "merge_threshold": 0.80,
    "link_threshold": 0.62,
    "reflect_every": 8,
    "vaults": "vaults",
}


def merge(base: Mapping, over: Mapping) -> dict:
    """Deep merge: maps are merged, other values of `over` win."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def read_env_file(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, _, v = line.removeprefix("export ").partition("=")
            out[k.strip()] = v.strip().strip("\"'")
    return out


def load(env_file: str | None = None, environ: Mapping[str, str] | None = None) -> dict:
    """LOOMGRAPH_LLM_CHAT_MODEL sets llm.chat_model; empty values are ignored; maps are given as JSON."""
    environ = os.environ if environ is None else environ
    values = {}
    if env_file and os.path.exists(env_file):
        with open(env_file) as f:
            values = read_env_file(f.read())
    values |= {k: v for k, v in environ.items() if k.startswith(PREFIX) and v}
    out = copy.deepcopy(DEFAULTS)
    for name, default in DEFAULTS.items():
        if isinstance(default, dict):
            for k, d in default.items():
                if v := values.get(f"{PREFIX}{name}_{k}".upper()):
                    out[name][k] = _typed(v, d)
        if v := values.get(f"{PREFIX}{name}".upper()):
            out[name] = merge(default, json.loads(v)) if isinstance(default, dict) else _typed(v, default)
    return out


def _typed(v: str, default):
    if isinstance(default, bool):
        return v.lower() in ("1", "true", "yes", "on")
    if isinstance(default, dict):
        return merge(default, json.loads(v))
    return type(default)(v)
