"""Readers, writers and series builders."""
