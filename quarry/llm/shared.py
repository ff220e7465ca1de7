"""The folder that the driver and all executors share."""

from quarry.plans.shared import checkpointed, discard, folder, place, temporary, written

__all__ = ["checkpointed", "discard", "folder", "place", "temporary", "written"]
