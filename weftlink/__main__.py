"""Runs the cascade: python -m weftlink DATASET OUT."""

from weftlink.cascade import main

main()
