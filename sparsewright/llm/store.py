"""Tables cut out of the lineage, in the folder that the whole cluster shares."""

from sparsewright.plans.scratch import cut, shared_dir

__all__ = ["cut", "shared_dir"]
