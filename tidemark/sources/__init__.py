"""Stores: tables on a shared file system, their reads and writes."""
