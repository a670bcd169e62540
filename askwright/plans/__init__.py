"""askwright.plans"""
