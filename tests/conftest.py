"""One local session for all tests, and log lines written as files."""

import json
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from meterline.session import local_session

    return local_session("tests", cpus=8)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def write_log(tmp_path):
    def write(name: str, lines: list[dict], folder: str = "sessions") -> Path:
        path = tmp_path / folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        text = "".join(json.dumps(line, separators=(",", ":")) + "\n" for line in lines)
        path.write_text(text)
        return path

    return write


def usage_line(ts, last=None, total=None, percent=None, reset=1786839350, **limits):
    """A counter line with equal input and total counts."""
    def counts(n):
        return {"input_tokens": n, "output_tokens": 0, "total_tokens": n}

    info = {}
    if last is not None:
        info["last_token_usage"] = counts(last)
    if total is not None:
        info["total_token_usage"] = counts(total)
    payload = {"type": "token_count", "info": info}
    if percent is not None:
        payload["rate_limits"] = {
            "limit_id": "codex",
            "primary": {"used_percent": percent, "window_minutes": 10080, "resets_at": reset},
            "plan_type": "pro",
            **limits,
        }
    return {"timestamp": ts, "type": "event_msg", "payload": payload}


def session_line(ts, **payload):
    return {"timestamp": ts, "type": "session_meta", "payload": payload}


def event_line(ts, kind, **payload):
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": kind, **payload}}
