"""The queries; importing any module of this package registers them all, in one order, as a task does that unpickles a function of one."""

from ledgerlens.plans import registry

__all__ = ["registry"]
