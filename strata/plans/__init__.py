"""Layer plans (bronze -> consumption), marts, and the driver-facing registry."""
