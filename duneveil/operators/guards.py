"""Keys from the environment, logs without values."""

from __future__ import annotations

import logging
import os
import re
import sys

MIN_KEY = 32
_ACCOUNT = re.compile(r"(?i)\bSA\s?\d{2}[\d\s]{10,}")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")
_DIGITS = re.compile(r"\d(?:[\s().\-]{0,3}\d){6,}")
MAX_AUDIT = 64


class ConfigError(RuntimeError):
    pass


def load_key(variable: str = "DUNEVEIL_KEY") -> bytes:
    """The pseudonym key: an environment variable of MIN_KEY characters or more, never echoed."""
    value = os.environ.get(variable, "")
    if len(value) < MIN_KEY:
        raise ConfigError(f"{variable} must be set to {MIN_KEY} characters or more")
    return value.encode()


def redacted(text: str) -> str:
    """Without account numbers, mail addresses and runs of seven digits or more, of any script."""
    return _DIGITS.sub("***", _MAIL.sub("***", _ACCOUNT.sub("***", text)))


class RedactingFilter(logging.Filter):
    """Messages without values; exceptions by type alone."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = redacted(record.getMessage()), ()
        if record.exc_info:
            record.msg, record.exc_info, record.exc_text = f"{record.msg} ({record.exc_info[0].__name__})", None, None
        return True


def install(logger: logging.Logger | None = None) -> None:
    """Redact what handlers of a logger write, and uncaught exceptions."""
    logger = logger or logging.getLogger()
    for handler in logger.handlers or [logging.StreamHandler()]:
        handler.addFilter(RedactingFilter())
    sys.excepthook = lambda kind, value, trace: print(f"{kind.__name__} (details withheld)", file=sys.stderr)


def audit_value(value: object) -> str:
    """What an audit log may hold of a value."""
    text = str(value)
    return "redacted" if len(text) > MAX_AUDIT or redacted(text) != text else text
