"""Declared schemas, readers, the clean-table writer and the driver-table adapter."""
