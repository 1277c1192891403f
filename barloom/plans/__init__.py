"""Registered queries; ``registry`` has them all."""
