"""askwright.operators"""
