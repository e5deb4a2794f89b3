"""Places that every executor and the driver can reach."""

from quarry.tables import new_path, shared_dir, stage

__all__ = ["new_path", "shared_dir", "stage"]
