"""Readers of tables, file trees and event logs."""
