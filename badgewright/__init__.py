"""Badgewright: loyalty and engagement analytics as Spark DataFrame plans."""
