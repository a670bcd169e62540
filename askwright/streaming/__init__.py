"""askwright.streaming"""
