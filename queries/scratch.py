"""Folders for what a query writes and reads back."""

from __future__ import annotations

import uuid

from airlog.session import ensure_checkpoint_dir


def scratch(t) -> str:
    """A new folder inside the shared checkpoint folder."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/query-{uuid.uuid4().hex}"
