"""Readers, writers, driver-table bindings and the distributed generator."""
