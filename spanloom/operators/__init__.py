"""spanloom.operators"""
