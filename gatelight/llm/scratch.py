"""Tables that cut lineage: the library's own, under the names that the operators use."""

from ..sources.shared import drop as release
from ..sources.shared import folder as shared_dir
from ..sources.shared import keep as materialize
from ..sources.shared import only

__all__ = ["materialize", "only", "release", "shared_dir"]
