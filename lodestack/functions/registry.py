"""Fixed values that results depend on: extensions, frameworks, labels, words. Plain data; users can pass their own."""

from __future__ import annotations

from typing import NamedTuple

UNKNOWN = "Unknown"

# Language by lower-case file extension.
EXTENSIONS = {
    ".go": "Go",
    ".java": "Java",
    ".py": "Python",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".rs": "Rust",
    ".kt": "Kotlin",
    ".kts": "Kotlin",
    ".swift": "Swift",
    ".rb": "Ruby",
    ".php": "PHP",
    ".c": "C",
    ".h": "C",
    ".cpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".hpp": "C++",
    ".cs": "C#",
}


class Framework(NamedTuple):
    name: str
    type: str
    language: str
    indicators: tuple[str, ...]
    package_keys: tuple[str, ...]


# Names, types, languages, content indicators and package keys.
FRAMEWORKS = [
    Framework("Spring Boot", "Backend", "Java", ("@SpringBootApplication", "@RestController", "@Service"), ("spring-boot-starter",)),
    Framework("Express", "Backend", "JavaScript", ("express()", "app.use("), ("express",)),
    Framework("FastAPI", "Backend", "Python", ("from fastapi import", "FastAPI("), ("fastapi",)),
    Framework("Gin", "Backend", "Go", ("gin.Default()", "gin.New()", ".GET(", ".POST("), ("github.com/gin-gonic/gin",)),
    Framework("Django", "Backend", "Python", ("from django", "INSTALLED_APPS", "settings.py"), ("django",)),
    Framework("Flask", "Backend", "Python", ("from flask import", "Flask(__name__)"), ("flask",)),
    Framework("NestJS", "Backend", "TypeScript", ("@Module(", "@Controller(", "@Injectable("), ("@nestjs/core",)),
    Framework("React", "UI", "JavaScript", ("import React", "from 'react'", "useState", "useEffect"), ("react",)),
    Framework("Vue.js", "UI", "JavaScript", ("<template>", "export default {", "Vue.component"), ("vue",)),
    Framework("Angular", "UI", "TypeScript", ("@Component(", "@NgModule(", "angular.json"), ("@angular/core",)),
    Framework("Svelte", "UI", "JavaScript", ("<script>", "<style>", ".svelte"), ("svelte",)),
    Framework("SolidJS", "UI", "JavaScript", ("import { createSignal", "from 'solid-js'"), ("solid-js",)),
    Framework("Preact", "UI", "JavaScript", ("from 'preact'", "import { h }"), ("preact",)),
    Framework("Alpine.js", "UI", "JavaScript", ("x-data", "x-bind", "x-on"), ("alpinejs",)),
    Framework("Next.js", "FullStack", "JavaScript", ("next.config", "pages/", "app/"), ("next",)),
    Framework("Nuxt.js", "FullStack", "JavaScript", ("nuxt.config", "pages/", ".nuxt/"), ("nuxt",)),
    Framework("Remix", "FullStack", "TypeScript", ("remix.config", "app/routes/"), ("@remix-run/react",)),
    Framework("SvelteKit", "FullStack", "JavaScript", ("svelte.config", "src/routes/"), ("@sveltejs/kit",)),
    Framework("Gatsby", "FullStack", "JavaScript", ("gatsby-config", "gatsby-node"), ("gatsby",)),
    Framework("Astro", "FullStack", "JavaScript", ("astro.config", ".astro"), ("astro",)),
    Framework("Material-UI", "UI", "JavaScript", ("@mui/material", "from '@mui/"), ("@mui/material",)),
    Framework("Ant Design", "UI", "JavaScript", ("from 'antd'", "import { Button } from 'antd'"), ("antd",)),
    Framework("Chakra UI", "UI", "JavaScript", ("@chakra-ui", "from '@chakra-ui/react'"), ("@chakra-ui/react",)),
    Framework("Tailwind CSS", "UI", "JavaScript", ("tailwind.config", "@tailwind", "className="), ("tailwindcss",)),
    Framework("shadcn/ui", "UI", "TypeScript", ("components/ui/", "cn(", "class-variance-authority"), ("class-variance-authority",)),
    Framework("Mantine", "UI", "JavaScript", ("@mantine/core", "from '@mantine/"), ("@mantine/core",)),
    Framework("Vuetify", "UI", "JavaScript", ("vuetify", "<v-app>", "<v-btn>"), ("vuetify",)),
    Framework("React Native", "UI", "JavaScript", ("react-native", "from 'react-native'", "<View>"), ("react-native",)),
    Framework("Vite", "Build", "JavaScript", ("vite.config", "import.meta.env"), ("vite",)),
    Framework("Webpack", "Build", "JavaScript", ("webpack.config", "module.exports"), ("webpack",)),
]

# Order in which types are shown.
TYPE_ORDER = ["Backend", "Frontend", "FullStack", "UI", "Build", "Testing", "ORM"]

# Architecture label by framework.
PATTERNS = {
    "Spring Boot": "Controller → Service → Repository",
    "Express": "Router → Handler → Service",
    "FastAPI": "Router → Handler → Service",
    "Gin": "Router → Handler → Service",
    "React": "Component-based Architecture",
    "Vue.js": "Component-based Architecture",
    "Angular": "Component-based Architecture",
    "Next.js": "File-based Routing + SSR/SSG",
    "Nuxt.js": "File-based Routing + SSR/SSG",
}

# Words that make a function name generic.
GENERIC_WORDS = ["manager", "helper", "util", "processor", "handler", "service", "controller", "provider", "factory", "builder", "wrapper", "adapter"]

# Directories that a scan leaves out, besides those that start with a dot.
IGNORED_DIRECTORIES = ["node_modules", "vendor", "dist", "build", "target", "__pycache__"]

# Files at the root of a repository that are worth a mention.
IMPORTANT_FILES = [
    "package.json", "go.mod", "requirements.txt", "pyproject.toml", "pom.xml", "build.gradle", "Cargo.toml",
    "tsconfig.json", "next.config.js", "vite.config.js", "tailwind.config.js", "angular.json", "nuxt.config.js",
]

# Least similarity of each level, from the highest.
SIMILARITY_LEVELS = [(0.95, "Nearly Identical"), (0.85, "Very Similar"), (0.75, "Similar"), (0.60, "Somewhat Similar")]
LOWEST_LEVEL = "Different"
DUPLICATE_THRESHOLD = 0.85
