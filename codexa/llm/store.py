"""Where the operators' intermediate tables go: as the library's do, in the folder that driver and executors share."""

from codexa.sources.store import drop, keep, partitions, shared_dir

__all__ = ["drop", "keep", "partitions", "shared_dir"]
