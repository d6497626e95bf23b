"""fotarium: photo-shoot triage analytics as Spark DataFrame operators."""

from fotarium.session import get_session

__all__ = ["get_session"]
