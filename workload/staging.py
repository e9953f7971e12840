"""Folders for data that a query derives and reads back."""

from __future__ import annotations

import uuid

from duskwatch.session import checkpoint_root


def staging(spark, name: str) -> str:
    """A fresh folder below the folder that all executors share."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
