"""Tables in the shared folder, as the operators of this subpackage use them."""

from ..store import delete, fresh_path, shared_dir, stash, unstash

__all__ = ["delete", "fresh_path", "shared_dir", "stash", "unstash"]
