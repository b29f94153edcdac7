"""Notifications as a stream."""
